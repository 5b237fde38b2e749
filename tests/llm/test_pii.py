"""Base spans against Python's re; disclosure against a plain count; sanitised texts; edges."""

import collections
import hashlib
import math
import random
import re

from vellum.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 13 <= len(d) <= 19 and luhn(d),
        "phone": lambda: 9 <= len(d) <= 15,
    }[kind]()


def base(t):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(PLAIN[k], t or "") if ok(k, m.group())]


def texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "1.2.3.4", "255.255.255.256", "001.02.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (555) 123-4567", "+12", "+1 2.3.4.5 678", "a@b", "@", "é😀", " ", "_", "%", ".", "-", "12", "\n", "word", "a@b.c_d@e.f", "12345678901234567890123"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_base_spans(spark):
    all_ = texts(700) + [None, "", "1" * 60_000, "a" * 60_000 + "@", "7 " * 30_000, "+" + "1.(" * 20_000, "4111111111111111 " * 200, "a@b.c " * 3000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(all_)], "doc_id bigint, text string, spans string")
    rows = pii.spans(df.union(df.limit(2))).collect()
    assert len(rows) == len(all_) + 2
    for r in rows:
        want = base(all_[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in pii.KINDS), all_[r.doc_id][:200]
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert r.spans.startswith(line)
    assert pii.spans(df.limit(0)).count() == 0


def test_disclosure(spark):
    filler = ["common words said and stand near many things number%d" % i for i in range(40)]
    rows = ["Write to Quixby at jo@x.org common words", "jo@x.org said Quixby again common things", "jo@x.org and Zebulon once", "Quixby"] + filler
    rows += ["jo@x.org and Copycat here"] * 5
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    # n(e) = 4 distinct texts, quixby near it in 2, in 3 texts altogether: under 0.85 of the content.
    n = len(set(rows))
    share = math.log(2 * n / (4 * 3)) / math.log(n / 4)
    assert share < pii.GENERALISE and all(r.n_term == 0 for r in got.values())
    df = spark.createDataFrame(list(enumerate(rows[:3] + filler)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    assert got[0].spans.endswith("term:9:15") and got[1].spans.endswith("term:14:20") and got[2].n_term == 0
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[0] == "Write to [TERM] at [EMAIL] common words" and clean[2] == "[EMAIL] and Zebulon once", clean
    assert all(clean[i] == t for i, t in enumerate(rows[:3] + filler) if i > 2)


def test_terms_are_hidden_wherever_they_stand(spark):
    filler = ["write said common words again and stand near many things number%d" % i for i in range(2000)]
    rows = ["Write to Quixby or Bob at jo@x.org common words", "jo@x.org said Quixby and Bob again", "Then Quixby went home alone", "bob was there, too",
            "Zed near zed@y.org", "zed@y.org of Zed"] + ["Zed in text %d" % i for i in range(3)] + [("far " * 40) + "jo@x.org"]
    df = spark.createDataFrame(list(enumerate(rows + filler)), "doc_id bigint, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    # Quixby and Bob stand beside the address in two of three texts; Zed in two of five, so only those hide it.
    assert clean[2] == "Then Qu* went home alone" and clean[3] == "bo* was there, too"
    assert clean[0] == "Write to Qu* or Bo* at [EMAIL] common words"
    assert clean[4] == "Ze* near [EMAIL]" and clean[6] == "Zed in text 0"
    assert all(clean[i] == t for i, t in enumerate(rows + filler) if i > len(rows))
    by_id = {r.doc_id: r for r in pii.spans(df).collect()}
    assert by_id[2].spans == "term:5:11" and by_id[2].n_term == 1 and by_id[6].spans == ""


def test_disclosure_against_a_plain_count(spark):
    """Random corpora: which words of which texts are hidden, by loops."""
    for seed in range(3):
        rng = random.Random(seed)
        people = [("name%s" % chr(97 + k), "u%d@x.org" % k) for k in range(8)]
        rows = []
        for _ in range(160):
            who, at = rng.choice(people)
            kind = rng.random()
            other = "".join(rng.choice("abcdefg") for _ in range(2))
            rows.append(f"{who} wrote {at} {other}" if kind < 0.3 else f"{who} alone {other}" if kind < 0.33 else f"some {other} words {rng.randrange(99)}")
        texts, words = sorted(set(rows)), lambda t: re.findall(r"[a-z]+", t)
        n = len(texts)
        ent = {t: {t[s:e] for _, s, e in base(t)} for t in texts}
        beside = {(e, w, t) for t in texts for e in ent[t] for w in words(t.replace(e, " ")) if len(w) >= pii.TERM_CHARS}
        n_e, n_t = collections.Counter(e for t in texts for e in ent[t]), collections.Counter(w for t in texts for w in set(words(t)))
        n_b = collections.Counter((e, w) for e, w, _ in beside)
        hide = collections.defaultdict(set)
        for (e, w), k in n_b.items():
            both = k if k > 1 else pii.ONCE
            share = math.log(both * n / (n_e[e] * n_t[w])) / math.log(n / n_e[e])
            if share >= pii.GENERALISE:
                for t in texts:
                    if (e, w, t) in beside or (both >= pii.SURE * n_t[w] and w in words(t)):
                        hide[t].add(w)
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
        got = {r.doc_id: r.n_term for r in pii.spans(df).collect()}
        assert all(got[i] == sum(w in hide[t] for w in words(t)) for i, t in enumerate(rows))
        assert sum(got.values()) > 10


def test_sanitised_keeps_rows_and_columns(spark):
    rows = [(1, None, "en"), (2, "", "en"), (2, "", "en"), (None, "a@b.c +1 2.3.4.5 6789", "x"), (4, "call 4111 1111 1111 1111 now é", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as row", "2 as digest", "3 as terms", "4 as all_", "5 as email")
    out = pii.sanitised(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str) == sorted(
        [(1, None), (2, ""), (2, ""), (0, "[EMAIL] [PHONE]"), (4, "call [CARD] now é")], key=str)


def test_terms_beside_entities_that_occur_once(spark):
    filler = ["ordinary words stand near many things number%d" % i for i in range(300)]
    filler = [t + " " + "".join(chr(97 + i // 26 ** k % 26) for k in range(5)) for i, t in enumerate(filler)]
    rows = ["ask Quixby at jo@x.org ordinary words", "ring +1 555 123 4567 with Zebulon"] + filler
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[0] == "as* Qu* at [EMAIL] ordinary words" and clean[1] == "ri* [PHONE] wi* Ze*"
    assert all(clean[i] == t for i, t in enumerate(rows) if i > 1)


def test_term_spans_on_the_tables(spark):
    """Against a plain count: every entity there occurs once, so a term must be in one text only."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    words = lambda t: re.findall(r"[^\W\d_]+", t)
    n = len(set(texts.values()))
    count = collections.Counter(w for t in set(texts.values()) for w in {x.lower() for x in words(t)})
    entities = collections.Counter(e for t in set(texts.values()) for e in {t[s:e] for _, s, e in base(t)})
    assert set(entities.values()) == {1} and math.log(0.5 * n) / math.log(n) >= pii.GENERALISE > math.log(0.5 * n / 2) / math.log(n)
    total = 0
    for r in pii.spans(docs).collect():
        t, near = texts[r.doc_id], set()
        for _, s, e in base(t):
            left, right = t[max(0, s - pii.CONTEXT):s], t[e:e + pii.CONTEXT]
            left = re.sub(r"^[^\W\d_]+", "", left) if len(left) == pii.CONTEXT else left
            right = re.sub(r"[^\W\d_]+$", "", right) if len(right) == pii.CONTEXT else right
            near |= {w.lower() for w in words(left) + words(right) if len(w) >= pii.TERM_CHARS}
        rare = {w for w in near if count[w] == 1}
        assert r.n_term == sum(w.lower() in rare for w in words(t)), r.doc_id
        total += r.n_term
    assert total > 50
