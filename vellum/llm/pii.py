"""Personal data, and terms that give it away.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers, found leftmost and
non-overlapping per kind; matches that fail a kind's test are dropped.  Each matched string is a
protected entity.  Words of at least ``TERM_CHARS`` letters within ``CONTEXT`` characters of an entity are
terms that may reveal it; what stands further away isn't looked at.  Over all distinct texts, a term's disclosure of an entity is their
pointwise mutual information divided by the entity's information content,
ln(n(e,t) N / (n(e) n(t))) / ln(N / n(e)): 1 if who reads the term learns the entity.  n(e,t) counts the texts where the
term stands beside the entity and n(t) those where it stands at all, so that n(e,t) / n(t) is how likely a reader of the
term is right to think of the entity.  A pair that meets in
one distinct text only may do so by chance and counts as ``ONCE`` of a text, which bounds its disclosure from
below: a rare word beside an entity that occurs once still passes, and the words' frequency keeps ordinary
ones out.  Terms are generalised (to their first letters) if their
disclosure is at least ``GENERALISE``, and removed from ``REMOVE`` up: throughout every text in which they stand
near that entity, and in all texts of the corpus if who reads the term is right more often than not (``SURE``).
Copies of one text count once, so that they are no evidence.

The patterns are possessive and anchored to the starts of runs, which finds the same matches as the plain
ones in linear time and without recursion.  Positions are code points, ends exclusive.

Only DataFrame and SQL functions run.  Null texts count as empty.  Repeated rows and null ids are kept.
Texts without a base span change only by terms that disclose an entity anywhere.  Extra columns are ignored, or kept by ``stage``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import job

CONTEXT, TERM_CHARS, ONCE, GENERALISE, REMOVE, SURE, PART = 60, 3, 0.5, 0.85, 0.95, 0.5, 16
#: Matches of a text that are placed at once.
RUN = 256
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text may hold a kind at all.
GUARDS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPANS = "array<struct<s:int,e:int>>"
LETTERS = r"\p{L}"


def _luhn(digits: Column) -> Column:
    """Whether the digits (a string) pass Luhn's test."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + _weighed(F.substr(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1),
    )
    return total % 10 == 0


def _weighed(d: Column, twice: Column) -> Column:
    return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")
    if kind == "card":
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _located(matches: Column, gaps: Column, valid) -> Column:
    """Spans of the valid matches, from the matches and what stands between them.  They are placed in runs, as
    appending to one long array would take the square of its length."""
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        s = acc["pos"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        span = F.array(F.struct(s.alias("s"), e.alias("e")))
        return F.struct(e.alias("pos"), F.when(valid(x["m"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        start = F.struct(acc["pos"].alias("pos"), none.alias("out"))
        return F.aggregate(part, start, step, lambda own: F.struct(own["pos"].alias("pos"), F.concat(acc["out"], own["out"]).alias("out")))

    n = F.size(matches)
    pairs = F.zip_with(F.slice(gaps, 1, n), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(RUN)), lambda k: F.slice(pairs, k, RUN))
    return F.aggregate(parts, F.struct(F.lit(0).alias("pos"), none.alias("out")), run, lambda acc: acc["out"])


def with_spans(df: DataFrame) -> DataFrame:
    """Adds a column of spans for each kind.  ``text`` must not be null."""
    none = F.array().cast(SPANS)
    for kind in KINDS:
        pattern, may = PATTERNS[kind], F.col("text").rlike(GUARDS[kind])
        df = df.withColumn("m_", F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
        df = df.withColumn("g_", F.when(F.size("m_") > 0, F.split("text", pattern, -1)))
        df = df.withColumn(kind, F.coalesce(_located(F.col("m_"), F.col("g_"), lambda m, k=kind: _valid(k, m)), none)).drop("m_", "g_")
    return df


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def _contexts(kind: str) -> Column:
    """Entities of a kind, each with the distinct lower-case terms near it."""

    def one(x: Column) -> Column:
        text = F.col("text")
        left = F.substr(text, F.greatest(x["s"] + 1 - CONTEXT, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
        right = F.substr(text, x["e"] + 1, F.lit(CONTEXT))
        word = F.lit(rf"(?<![{LETTERS}])[{LETTERS}]{{{TERM_CHARS},}}(?![{LETTERS}])")
        near = F.concat(F.regexp_extract_all(_whole(left, "left"), word, F.lit(0)), F.regexp_extract_all(_whole(right, "right"), word, F.lit(0)))
        return F.struct(F.substr(text, x["s"] + 1, x["e"] - x["s"]).alias("entity"), F.array_distinct(F.transform(near, lambda w: F.lower(w))).alias("terms"))

    return F.transform(F.col(kind), one)


def _whole(part: Column, side: str) -> Column:
    """Without the word that the context's limit may have cut."""
    cut = rf"^[{LETTERS}]+" if side == "left" else rf"[{LETTERS}]+$"
    return F.when(F.length(part) >= CONTEXT, F.regexp_replace(part, cut, "")).otherwise(part)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, base spans, and entities with the terms near them; no text."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_spans(df.withColumn("digest", _digest(F.col("text"))))
    any_ = sum((F.size(k) for k in KINDS), F.lit(0)) > 0
    context = F.when(any_, F.concat(*[_contexts(k) for k in KINDS]))
    return df.select("doc_id", "digest", *KINDS, context.alias("contexts"))


def disclosing(docs: DataFrame, base: DataFrame) -> DataFrame | None:
    """Terms to hide in a text, as (digest, terms: array of (term, remove)); None if there are none.
    ``base``: found(docs), written."""
    seen = base.where("contexts is not null").select("digest", F.explode("contexts").alias("c")).select("digest", "c.entity", "c.terms")
    near = seen.select("digest", "entity", F.explode("terms").alias("term")).distinct()
    n_texts = base.select("digest").distinct().count()
    n = F.lit(float(max(n_texts, 1)))
    entities = seen.select("digest", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    pairs = pairs.withColumn("n_both", F.when(F.col("n_both") == 1, ONCE).otherwise(F.col("n_both").cast("double")))
    # The most texts that may hold the term if it is still to disclose the entity.
    most = F.col("n_both") * n / F.col("n_entity") * F.pow(n / F.col("n_entity"), F.lit(-GENERALISE)) * (1 + 1e-9)
    pairs = pairs.join(entities, "entity").where(F.col("n_entity") < n).withColumn("most", most)
    beside = near.select("digest", "term").distinct().groupBy("term").agg(F.count("*").alias("n_beside"))
    pairs = job.written(pairs.join(beside, "term").where("n_beside <= most").drop("n_beside"), "pii-pairs")
    if pairs.isEmpty():
        return None
    terms = job.written(pairs.groupBy("term").agg(F.max("most").alias("most")), "pii-terms")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(text.alias("text"), _digest(text).alias("digest"))

    def texts_with(terms: DataFrame, rows: DataFrame) -> DataFrame:
        """(digest, term) for the distinct texts among the rows that hold each term."""
        word = F.explode(F.array_distinct(F.split(F.lower("text"), rf"[^{LETTERS}]+", -1))).alias("term")
        return rows.select("digest", word).join(job.maybe_broadcast(terms.select("term")), "term", "left_semi").distinct()

    # A part of the texts gives a lower bound, which rules out frequent words before all texts are counted: it loses no
    # term that could pass, and what is counted in full has few texts each.
    count = F.count("*").alias("n_term")
    low = texts_with(terms, keyed.where(F.pmod(F.xxhash64("digest"), F.lit(PART)) == 0)).groupBy("term").agg(count)
    terms = job.written(terms.join(low, "term", "left").where("n_term is null or n_term <= most").select("term"), "pii-rare-terms")
    held = job.written(texts_with(terms, keyed), "pii-held")
    told = pairs.join(held.groupBy("term").agg(count), "term")
    content = F.log(n / F.col("n_entity"))
    share = F.when(content > 0, F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term"))) / content).otherwise(0.0)
    told = told.select("entity", "term", F.round(share, 9).alias("share"), (F.col("n_both") >= SURE * F.col("n_term")).alias("sure"))
    told = job.written(told.where(F.col("share") >= GENERALISE), "pii-told")
    remove = (F.col("share") >= REMOVE).alias("remove")
    beside = near.join(told, ["entity", "term"]).select("digest", "term", remove)
    anywhere = held.join(told.where("sure").groupBy("term").agg(F.max("share").alias("share")), "term").select("digest", "term", remove)
    hide = beside.unionByName(anywhere).groupBy("digest", "term").agg(F.max("remove").alias("remove"))
    hide = job.written(hide.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("term", "remove"))).alias("terms")), "pii-hide")
    return None if hide.isEmpty() else hide


def _term_pattern(terms: Column) -> Column:
    return F.concat(F.lit(rf"(?iu)(?<![{LETTERS}])(?:"), F.array_join(F.transform(terms, lambda t: t["term"]), "|"), F.lit(rf")(?![{LETTERS}])"))


def with_term_spans(df: DataFrame) -> DataFrame:
    """Adds ``term``, the spans of ``terms`` in ``text``, where there are terms."""
    df = df.withColumn("p_", _term_pattern(F.col("terms")))
    df = df.withColumn("m_", F.regexp_extract_all("text", F.col("p_"), F.lit(0)))
    df = df.withColumn("g_", F.when(F.size("m_") > 0, F.split("text", F.col("p_"), -1)))
    return df.withColumn("term", _located(F.col("m_"), F.col("g_"), lambda m: F.lit(True))).drop("p_", "m_", "g_")


def spans(docs: DataFrame) -> DataFrame:
    base = job.written(found(docs), "pii")
    hide = disclosing(docs, base)
    none = F.array().cast(SPANS)
    if hide is None:
        base = base.withColumn("term", none)
    else:
        text = F.coalesce(F.col("text"), F.lit(""))
        own = docs.select(text.alias("text"), _digest(text).alias("digest")).join(job.maybe_broadcast(hide), "digest")
        own = job.written(with_term_spans(own).groupBy("digest").agg(F.first("term").alias("term")), "pii-term-spans")
        base = base.join(job.maybe_broadcast(own), "digest", "left").withColumn("term", F.coalesce("term", none))
    base_text = F.concat_ws(",", *[_joined(k, F.col(k)) for k in KINDS])
    return base.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(base_text.cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", *[_joined(k, F.col(k)) for k in (*KINDS, "term")]).alias("spans"),
        F.size("term").cast("bigint").alias("n_term"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with base spans replaced by their kind in brackets, and terms removed or
    generalised.  Where spans of kinds overlap, they are replaced together by the first one's;
    a base span comes before a term that starts with it."""
    base = job.written(found(docs), "pii")
    hide = disclosing(docs, base)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col("text"), F.lit(""))
    work = docs.select(row, text.alias("text"), _digest(text).alias("digest"))
    if hide is None:
        work = work.withColumn("terms", F.lit(None).cast("array<struct<term:string,remove:boolean>>"))
    else:
        work = work.join(job.maybe_broadcast(hide), "digest", "left")
    work = with_spans(work)
    work = work.withColumn("p_", _term_pattern(F.col("terms")))
    work = work.withColumn("m_", F.when(F.col("terms").isNotNull(), F.regexp_extract_all("text", F.col("p_"), F.lit(0))))
    work = work.withColumn("g_", F.when(F.size("m_") > 0, F.split("text", F.col("p_"), -1)))
    work = work.withColumn("term", F.coalesce(_located(F.col("m_"), F.col("g_"), lambda m: F.lit(True)), F.array().cast(SPANS)))

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("order"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("by")))

    def hidden(x: Column) -> Column:
        word = F.substr("text", x["s"] + 1, x["e"] - x["s"])
        gone = F.exists("terms", lambda t: (t["term"] == F.lower(word)) & t["remove"])
        return F.struct(x["s"].alias("s"), F.lit(1).alias("order"), x["e"].alias("e"), F.when(gone, F.lit("[TERM]")).otherwise(F.concat(F.substr(word, F.lit(1), F.lit(2)), F.lit("*"))).alias("by"))

    work = work.withColumn("all_", F.array_sort(F.concat(*[tagged(k) for k in KINDS], F.transform("term", hidden))))
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        apart = x["s"] >= acc["pos"]
        return F.struct(
            F.greatest(acc["pos"], x["e"]).alias("pos"),
            F.when(apart, F.concat(acc["out"], F.substr("text", acc["pos"] + 1, x["s"] - acc["pos"]), x["by"])).otherwise(acc["out"]).alias("out"),
        )

    new = F.aggregate("all_", zero, step, lambda acc: F.concat(acc["out"], F.substr("text", acc["pos"] + 1, F.greatest(F.length("text") - acc["pos"], F.lit(0)))))
    work = work.withColumn("new_", F.when(F.size("all_") > 0, new).otherwise(F.col("row.text")))
    return work.select(*[F.col("new_").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(job.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, sanitised; n_chars follows the text."""
    return sanitised(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)
