"""Language of words and documents by a linear-chain conditional random field.

A text's words (runs of ASCII letters and of longer characters, with at least one letter) form
chains.  A word's emission is the sum of learned weights of its features: hashed character n-grams of
2 to 4 bytes with word boundaries (those at a boundary are the affixes), the word itself, and for
each language whether the word is in that language's lexicon.  Transitions between languages are
learned with the weights, by full-batch AdaGrad on the chains' likelihood.  Training chains are made
of fragments of differently labelled documents, so that transitions describe code-switched text.
At prediction, forward-backward gives each word's marginals in the document's one chain, however long it is; a
document's language is that of the largest mean marginal, which is its score.

The model is fitted on at most ``DOCS_PER_LANG`` documents of each language (those of the least hash
of doc_id among documents that are not held out and have at most ``LONGEST`` characters), whole texts, and on fewer of
each, one at least, if all languages together have more than ``TRAIN_DOCS``; every
document is predicted, whole.  Memory grows with the longest text, by a number for each of its words and language.

The pipeline's stage has no held-out documents and no sample: ``fit_all`` learns from every row with a text and a lang.  Rows are
shuffled, so that chains mix languages however the rows lie, and written once as chunks of coded chains with their distinct words'
features; each of the ``ROUNDS`` gradients is a sum over all chunks.  Lexicons are of the counts of all words, by 64-bit hashes;
of what is broadcast they alone grow with the input, by 12 bytes for each word of one language.

Null texts, and texts without a letter, get ``und`` with score 0, as do all texts if there is nothing
to learn from.  Rows with null lang are never learned from (nor, but by the stage, those with null doc_id) but are
predicted.  Ties go to the language that sorts first.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import job, text

DOCS_PER_LANG, TRAIN_DOCS, LONGEST, BUCKETS, ROUNDS = 150, 20_000, 100_000, 1 << 15, 40
#: Occurrences in what is learned from, and share of them in one language, that put a word into a lexicon.
LEX_COUNT, LEX_SHARE = 3, 0.9
UNKNOWN = "und"
#: Words of a training chain in a chunk; a chunk's words, their distinct ones with features, (word, language) counts, and transitions;
#: what the gradients need of it, with lexicons.
CHAIN = 64
CHUNK = "n bigint, codes binary, hashes binary, feats binary, sizes binary, keys binary, counts binary, seen binary"
CODED = "codes binary, feats binary, sizes binary, lex binary"
#: Rows of chunks that a Parquet reader decodes at once.
READ_ROWS = "1"
#: Bytes of files whose texts one task makes chunks of.
TASK_BYTES = 16 << 20
#: How chunks are written.  A row is megabytes: by default Parquet looks at sizes after a hundred rows only, so that a page, which its
#: readers hold whole, would grow with a task's texts.
WRITTEN = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.page.size.check.estimate": "false"} | {
    f"parquet.{what}.size.row.check.{end}": 1 for what in ("block", "page") for end in ("min", "max")}
OUT = "doc_id bigint, held_out boolean, lang_pred string, score double, n_words bigint, n_switches bigint"


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # [BUCKETS, L]
    lex_weight: np.ndarray  # [L, L]
    trans: np.ndarray  # [L, L], from row to column
    lexicon: dict[bytes, int]

    def emissions(self, pieces: list[bytes]) -> np.ndarray:
        feats, ptr = features(pieces)
        out = np.zeros((len(pieces), len(self.langs)), np.float32)
        for at in range(0, len(pieces), 50_000):
            to = min(len(pieces), at + 50_000)
            part = self.weight[feats[ptr[at]:ptr[to]]]
            out[at:to] = np.add.reduceat(part, ptr[at:to] - ptr[at], axis=0)
        lex = self.lexicons_of(pieces)
        out[lex >= 0] += self.lex_weight[lex[lex >= 0]]
        return out

    def lexicons_of(self, pieces: list[bytes]) -> np.ndarray:
        """The language in whose lexicon each word is, or -1."""
        get = self.lexicon.get
        return np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))


@dataclass
class Lexicon:
    """Words by their hashes (rising), each with its language."""

    hashes: np.ndarray
    langs: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.langs[at], -1)


@dataclass
class WholeModel(Model):
    lexicon: Lexicon

    def lexicons_of(self, pieces: list[bytes]) -> np.ndarray:
        return self.lexicon.of(text.hash_pieces(pieces))


def features(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, one after another, and words + 1 places in them."""
    line = b"".join([b"\x02" + p + b"\x03" for p in pieces])
    raw = np.frombuffer(line + b"\x03\x03\x03", np.uint8).astype(np.uint64)
    n = len(line)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 2
    first = np.cumsum(size) - size
    end = raw == 3
    grams = []
    place = []
    value = raw[:n].copy()
    alive = ~end[:n]
    for k in (1, 2, 3):
        value = (value << np.uint64(8)) | raw[k:n + k]
        at = np.flatnonzero(alive)
        grams.append(text.mix64(value[at], k))
        place.append(at)
        alive = alive & ~end[k:n + k]
    grams.append(text.mix64(text.hash_pieces(pieces), 7))
    place.append(first)
    where = np.concatenate(place)
    order = np.argsort(where, kind="stable")
    feats = (np.concatenate(grams)[order] % np.uint64(BUCKETS)).astype(np.int32)
    ptr = np.searchsorted(where[order], np.append(first, n))
    return feats, ptr


def marginals(e: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """e: [T, N, L] emissions, mask: [T, N] true where a chain has a word (a prefix of T).  Returns the
    marginals and the expected transition counts."""
    t_max, n, labels = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True))
    a = np.exp(trans - trans.max())
    fwd = np.empty_like(p)
    fwd[0] = p[0] / p[0].sum(1, keepdims=True)
    for t in range(1, t_max):
        x = (fwd[t - 1] @ a) * p[t]
        fwd[t] = x / x.sum(1, keepdims=True)
    back = np.ones((n, labels), p.dtype)
    out = np.empty_like(p)
    out[-1] = fwd[-1]
    expected = np.zeros((labels, labels))
    for t in range(t_max - 1, 0, -1):
        y = back * p[t]
        y = np.where(mask[t][:, None], y, 1.0)  # nothing follows a chain's end
        z = ((fwd[t - 1] @ a) * y).sum(1, keepdims=True)
        live = mask[t]
        expected += a * (fwd[t - 1][live].T @ (y[live] / z[live]))
        new = y @ a.T
        new /= new.sum(1, keepdims=True)
        back = np.where(live[:, None], new, 1.0)
        x = fwd[t - 1] * back
        out[t - 1] = x / x.sum(1, keepdims=True)
    return out, expected


def chain_marginals(weight: np.ndarray, codes: np.ndarray, ptr: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Marginals [words, L] of whole chains, all of them side by side, word by word.  weight: exp(emission) of
    each distinct word; codes: the words; ptr: the chains' places in them."""
    a = np.exp(trans - trans.max())
    size = np.diff(ptr)
    first = ptr[:-1][order := np.argsort(-size, kind="stable")]
    longest = int(size.max(initial=0))
    # Chains by falling length: those with a word number t come first.
    alive = np.searchsorted(-size[order], -np.arange(longest + 1), "left").tolist()
    out = np.empty((len(codes), weight.shape[1]), weight.dtype)
    x = None
    for t in range(longest):
        at = first[:alive[t]] + t
        x = weight[codes[at]] if x is None else (x[:alive[t]] @ a) * weight[codes[at]]
        x /= x.sum(1, keepdims=True)
        out[at] = x
    back = np.ones((0, weight.shape[1]), weight.dtype)
    a_t = np.ascontiguousarray(a.T)
    for t in range(longest - 2, -1, -1):
        ended = alive[t + 1]  # chains with a next word
        at = first[:ended] + t
        if len(back) < ended:  # those whose last word is the next one
            back = np.concatenate([back, np.ones((ended - len(back), back.shape[1]), back.dtype)])
        back = (back * weight[codes[at + 1]]) @ a_t
        back /= back.sum(1, keepdims=True)
        y = out[at] * back
        y /= y.sum(1, keepdims=True)
        out[at] = y
    return out


def train(texts: list[str], labels: list[str], seed: int = 3) -> Model | None:
    langs = sorted(set(labels))
    if not langs:
        return None
    index = {x: i for i, x in enumerate(langs)}
    c = text.words(pa.array(texts, pa.large_string()))
    y_doc = np.array([index[x] for x in labels])
    y = y_doc[c.docs]
    n_lang = len(langs)
    # Lexicons, from the sample's counts.
    table = np.zeros((len(c.pieces), n_lang))
    np.add.at(table, (c.codes, y), 1)
    total = table.sum(1)
    in_lex = np.flatnonzero((total >= LEX_COUNT) & (table.max(1) >= LEX_SHARE * total))
    lexicon = {c.pieces[i]: int(table[i].argmax()) for i in in_lex}
    lex = np.full(len(c.pieces), -1)
    lex[in_lex] = table[in_lex].argmax(1)
    # Fragments of 4 to 24 words, in random order, joined to chains.
    rng = np.random.default_rng(seed)
    frag = []
    for d in range(len(texts)):
        at, end = int(c.ptr[d]), int(c.ptr[d + 1])
        while at < end:
            to = min(end, at + int(rng.integers(4, 25)))
            frag.append((at, to))
            at = to
    if not frag:
        return None
    rng.shuffle(frag)
    order = np.concatenate([np.arange(a, b) for a, b in frag])
    length = 64
    n = -(-len(order) // length)
    full = np.full(n * length, -1, np.int64)
    full[:len(order)] = order
    grid = full.reshape(n, length).T  # [T, N]
    mask = grid >= 0
    code, gold = c.codes[grid], y[grid]
    feats, ptr = features(c.pieces)
    word_of = np.repeat(np.arange(len(c.pieces)), np.diff(ptr))
    w = np.zeros((BUCKETS, n_lang))
    lw = np.zeros((n_lang, n_lang))
    tr = np.zeros((n_lang, n_lang))
    gw, glw, gtr = np.full_like(w, 1e-6), np.full_like(lw, 1e-6), np.full_like(tr, 1e-6)
    seen = np.zeros((n_lang, n_lang))
    both = mask[1:] & mask[:-1]
    np.add.at(seen, (gold[:-1][both], gold[1:][both]), 1)
    hot = np.zeros((len(c.pieces), n_lang))
    np.add.at(hot, (code[mask], gold[mask]), 1)
    has = lex >= 0
    rate = 0.5
    for _ in range(ROUNDS):
        e = np.add.reduceat(w[feats], ptr[:-1], axis=0)
        e[has] += lw[lex[has]]
        grid_e = e[code].astype(np.float32)
        grid_e[~mask] = 0
        m, expected = marginals(grid_e, tr.astype(np.float32), mask)
        g = hot - np.stack([np.bincount(code[mask], m[..., k][mask], len(c.pieces)) for k in range(n_lang)], 1)
        g /= len(order) / 1000
        step = np.stack([np.bincount(feats, g[word_of, k], BUCKETS) for k in range(n_lang)], 1) - 1e-4 * w
        gw += step**2
        w += rate * step / np.sqrt(gw)
        step = np.zeros_like(lw)
        np.add.at(step, lex[has], g[has])
        glw += step**2
        lw += rate * step / np.sqrt(glw)
        step = (seen - expected) / len(order) - 1e-4 * tr
        gtr += step**2
        tr += rate * step / np.sqrt(gtr)
    return Model(langs, w.astype(np.float32), lw.astype(np.float32), tr.astype(np.float32), lexicon)


def word_marginals(model: Model, col: pa.Array) -> tuple[np.ndarray, np.ndarray, text.Coded, np.ndarray]:
    """Marginals [words, L] of all words with a letter, the documents' places in them, the words, and
    the places of those words among all."""
    c = text.words(col)
    n_lang = len(model.langs)
    letter = np.fromiter((any(ch.isalpha() for ch in p.decode("utf-8", "replace")) for p in c.pieces), bool, len(c.pieces))
    keep = np.flatnonzero(letter[c.codes]) if len(c.codes) else np.zeros(0, np.int64)
    codes = c.codes[keep]
    ptr = np.searchsorted(keep, c.ptr)
    if not len(codes):
        return np.zeros((0, n_lang), np.float32), ptr, c, keep
    e = model.emissions(c.pieces)
    weight = np.exp(e - e.max(axis=1, keepdims=True))
    return chain_marginals(weight, codes, ptr, model.trans), ptr, c, keep


def fit(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> Model | None:
    """Needs doc_id, text and lang.  Scans: languages, ids with them, then the chosen texts."""
    usable = docs.where("doc_id is not null and lang is not null").where(F.length("text") <= LONGEST).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    n_langs = usable.select("lang").distinct().count()
    per_lang = max(1, min(per_lang, TRAIN_DOCS // max(n_langs, 1)))
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("k", F.row_number().over(rank)).where(F.col("k") <= per_lang).select("doc_id")
    chosen = job.written(chosen.distinct(), "langcrf-chosen")
    rows = usable.join(job.maybe_broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text", "lang").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.lang, r.text))
    return train([r.text for r in rows], [r.lang for r in rows])


def chunk(col: pa.Array, y_doc: np.ndarray, n_lang: int, seed: int = 3) -> tuple | None:
    """A row of ``CHUNK`` for some texts and their languages: fragments in random order, joined to chains of ``CHAIN`` words."""
    c = text.words(col)
    total = len(c.codes)
    if not total:
        return None
    rng = np.random.default_rng(seed)
    starts = np.unique(np.concatenate([np.cumsum(rng.integers(4, 25, total // 4 + 1)), c.ptr]))
    starts = starts[starts < total]
    mixed = rng.permutation(len(starts))
    order = text.ragged_take(np.arange(total), starts[mixed], np.diff(starts, append=total)[mixed])
    y = y_doc.astype(np.int32)[c.docs]
    hot = np.bincount(c.codes * n_lang + y, minlength=len(c.pieces) * n_lang)
    keys = np.flatnonzero(hot)
    y = y[order]
    inside = np.flatnonzero(np.arange(1, total) % CHAIN)
    seen = np.bincount(y[inside] * n_lang + y[inside + 1], minlength=n_lang * n_lang)
    feats, sizes = [], []
    for at in range(0, len(c.pieces), 20_000):
        f, ptr = features(c.pieces[at:at + 20_000])
        feats.append(f.astype(np.uint16))
        sizes.append(np.diff(ptr).astype(np.int32))
    arrays = (c.codes[order].astype(np.int32), text.hash_pieces(c.pieces), np.concatenate(feats), np.concatenate(sizes), keys, hot[keys], seen)
    return total, *(a.tobytes() for a in arrays)


def chunks(docs: DataFrame, langs: list[str]) -> DataFrame:
    """All texts as coded chains.  docs: doc_id, text, lang.  Rows meet in an order of hashes."""
    spark = docs.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions(), -(-job.size_of(docs) // TASK_BYTES))
    mixed = docs.select("text", "lang", F.xxhash64("doc_id", "text", F.spark_partition_id()).alias("mix"))
    mixed = mixed.repartition(n, "mix").sortWithinPartitions("mix").select("text", "lang")
    index = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Whole batches: the fewer chunks, the less often a word's features are added up.
            row = chunk(batch.column("text"), np.array([index[x] for x in batch.column("lang").to_pylist()]), len(langs))
            if row:
                yield _row(row, CHUNK)

    return mixed.mapInArrow(text.tidy(run), CHUNK)


def _row(values: tuple, kind: str) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], names=[f.split()[0] for f in kind.split(", ")])


def _arrays(batch: pa.RecordBatch, **kinds) -> Iterator[list[np.ndarray]]:
    for row in zip(*(batch.column(name) for name in kinds)):
        yield [np.frombuffer(v.as_buffer(), kind) for v, kind in zip(row, kinds.values())]


def lexicon(coded: DataFrame, n_lang: int) -> Lexicon:
    """The words of ``LEX_COUNT`` and more in all chunks that have ``LEX_SHARE`` of them in one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, keys, counts in _arrays(batch, hashes=np.uint64, keys=np.int64, counts=np.int64):
                yield pa.record_batch([pa.array(h[keys // n_lang].view(np.int64)), pa.array(keys % n_lang), pa.array(counts)], names=["h", "y", "n"])

    words = coded.select("hashes", "keys", "counts").mapInArrow(text.tidy(run), "h bigint, y bigint, n bigint")
    words = words.groupBy("h", "y").agg(F.sum("n").alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.max(F.struct("n", "y")).alias("top"))
    found = words.where((F.col("n") >= LEX_COUNT) & (F.col("top.n") >= LEX_SHARE * F.col("n"))).select("h", F.col("top.y").cast("int").alias("y")).toArrow()
    h = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return Lexicon(h[order], found.column("y").to_numpy()[order])


def expected_counts(weight: np.ndarray, codes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's expected counts of languages of each distinct word, and of transitions, in chains of ``CHAIN``
    words, all side by side.  weight: exp(emission) of each distinct word; codes: the words."""
    total, (n_words, n_lang) = len(codes), weight.shape
    n = -(-total // CHAIN)
    short = total - (n - 1) * CHAIN  # words of the last chain
    grid = np.zeros(n * CHAIN, np.int64)
    grid[:total] = codes
    grid = np.ascontiguousarray(grid.reshape(n, CHAIN).T)
    a, w = np.exp(trans - trans.max()), np.ascontiguousarray(weight.T)
    a_t = np.ascontiguousarray(a.T)
    p = np.take(w, grid, axis=1)
    out = np.empty((n_lang, CHAIN, n), w.dtype)
    x = p[:, 0] / p[:, 0].sum(0)
    out[:, 0] = x
    for t in range(1, CHAIN):
        x = a_t @ x
        x *= p[:, t]
        x /= x.sum(0)
        out[:, t] = x
    pairs = np.zeros((n_lang, n_lang))
    back = np.ones((n_lang, n), w.dtype)
    for t in range(CHAIN - 1, 0, -1):
        y = back * p[:, t]
        back = a @ y
        x = np.ascontiguousarray(out[:, t - 1])
        m = x * back
        norm = m.sum(0)
        m /= norm
        y /= norm
        back /= back.sum(0)
        if t >= short:  # nothing follows the last chain's end
            m[:, -1], back[:, -1], y[:, -1] = x[:, -1], 1, 0
        pairs += a * (x @ y.T)
        out[:, t - 1] = m
    out[:, short:, -1] = 0
    grid = grid.ravel()
    return np.stack([np.bincount(grid, out[k].ravel(), n_words) for k in range(n_lang)], 1), pairs


def _add(total: np.ndarray, table: np.ndarray, pairs: np.ndarray, feats: np.ndarray, sizes: np.ndarray, lex: np.ndarray) -> None:
    """Adds counts of distinct words [words, L] to those of their features and lexicons, and counts of transitions."""
    n_lang = table.shape[1]
    feats = feats.astype(np.int64)
    for k in range(n_lang):
        total[:BUCKETS, k] += np.bincount(feats, np.repeat(table[:, k], sizes), BUCKETS)
        total[BUCKETS:BUCKETS + n_lang, k] += np.bincount(lex[lex >= 0], table[lex >= 0, k], n_lang)
    total[BUCKETS + n_lang:] += pairs


def fit_all(docs: DataFrame) -> Model | None:
    """The model of all rows that have a text and a lang; needs doc_id, too.  The same steps as in train()."""
    spark = docs.sparkSession
    usable = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    langs = sorted(r["lang"] for r in usable.select("lang").distinct().collect())
    if not langs:
        return None
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before, paths = spark.conf.get(key), [job.new_path(spark, "langcrf-chunks"), job.new_path(spark, "langcrf-coded")]
    spark.conf.set(key, READ_ROWS)
    try:
        return _fit_all(usable, langs, *paths)
    finally:
        spark.conf.set(key, before)
        for path in paths:
            job.remove(spark, path)


def _fit_all(docs: DataFrame, langs: list[str], path: str, coded_path: str) -> Model | None:
    """Chunks whose files are small are worked on by the driver, else each gradient is a job."""
    spark, n_lang = docs.sparkSession, len(langs)
    shape = (BUCKETS + 2 * n_lang, n_lang)
    chunks(docs, langs).write.options(**WRITTEN).parquet(path)
    rows = spark.read.schema(CHUNK).parquet(path)
    n = rows.agg(F.sum("n")).first()[0]
    if not n:
        return None
    lex = lexicon(rows, n_lang)
    known = spark.sparkContext.broadcast(lex)

    def with_lexicons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, h, feats, sizes in _arrays(batch, codes=np.int32, hashes=np.uint64, feats=np.uint16, sizes=np.int32):
                yield _row(tuple(a.tobytes() for a in (codes, feats, sizes, known.value.of(h).astype(np.int32))), CODED)

    def gold(total: np.ndarray, batch: pa.RecordBatch) -> None:
        kinds = {"hashes": np.uint64, "feats": np.uint16, "sizes": np.int32, "keys": np.int64, "counts": np.int64, "seen": np.int64}
        for h, feats, sizes, keys, counts, seen in _arrays(batch, **kinds):
            table = np.zeros(len(h) * n_lang)
            table[keys] = counts
            _add(total, table.reshape(-1, n_lang), seen.reshape(n_lang, n_lang), feats, sizes, known.value.of(h))

    want = job.summed(rows, ["hashes", "feats", "sizes", "keys", "counts", "seen"], gold, shape)
    rows.select("codes", "hashes", "feats", "sizes").mapInArrow(text.tidy(with_lexicons), CODED).write.options(**WRITTEN).parquet(coded_path)
    job.remove(spark, path)
    known.destroy()
    coded = spark.read.schema(CODED).parquet(coded_path)
    local = coded.toArrow().to_batches() if job.size_of(coded) <= job.BROADCAST_BYTES else None
    w, lw, tr = np.zeros((BUCKETS, n_lang)), np.zeros((n_lang, n_lang)), np.zeros((n_lang, n_lang))
    gw, glw, gtr = np.full_like(w, 1e-6), np.full_like(lw, 1e-6), np.full_like(tr, 1e-6)
    rate = 0.5
    for _ in range(ROUNDS):
        now = [a.astype(np.float32) for a in (w, lw, tr)]
        if local is None:
            shared = spark.sparkContext.broadcast(now)
            got = job.summed(coded, coded.columns, lambda total, batch, shared=shared: _expect(total, batch, *shared.value), shape)
            shared.destroy()
        else:
            got = np.zeros(shape)
            for batch in local:
                _expect(got, batch, *now)
        left = want - got
        step = left[:BUCKETS] / (n / 1000) - 1e-4 * w
        gw += step**2
        w += rate * step / np.sqrt(gw)
        step = left[BUCKETS:BUCKETS + n_lang] / (n / 1000)
        glw += step**2
        lw += rate * step / np.sqrt(glw)
        step = left[BUCKETS + n_lang:] / n - 1e-4 * tr
        gtr += step**2
        tr += rate * step / np.sqrt(gtr)
    return WholeModel(langs, w.astype(np.float32), lw.astype(np.float32), tr.astype(np.float32), lex)


def _expect(total: np.ndarray, batch: pa.RecordBatch, w: np.ndarray, lw: np.ndarray, tr: np.ndarray) -> None:
    """Adds what a model expects of rows of ``CODED``."""
    columns = np.ascontiguousarray(w.T)
    for codes, feats, sizes, lex in _arrays(batch, codes=np.int32, feats=np.uint16, sizes=np.int32, lex=np.int32):
        at = np.cumsum(sizes) - sizes
        e = np.stack([np.add.reduceat(np.take(c, feats), at) for c in columns], 1)
        e[lex >= 0] += lw[lex[lex >= 0]]
        table, pairs = expected_counts(np.exp(e - e.max(axis=1, keepdims=True)), codes, tr)
        _add(total, table, pairs, feats, sizes, lex)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in text.slices(batch):
                ids = part.column("doc_id").cast(pa.int64())
                n = part.num_rows
                pred, score = [UNKNOWN] * n, np.zeros(n)
                words, switches = np.zeros(n, np.int64), np.zeros(n, np.int64)
                if model is not None:
                    m, ptr, _, _ = word_marginals(model, part.column("text"))
                    words = np.diff(ptr)
                    some = np.flatnonzero(words)
                    if len(some):
                        mean = np.add.reduceat(m, ptr[some], axis=0, dtype=np.float64) / words[some][:, None]
                        best = mean.argmax(1)
                        score[some] = np.clip(mean[np.arange(len(some)), best], 0, 1)
                        for d, b in zip(some.tolist(), best.tolist()):
                            pred[d] = model.langs[b]
                        label = m.argmax(1)
                        change = np.zeros(len(label), np.int64)
                        change[1:] = label[1:] != label[:-1]
                        change[ptr[some]] = 0
                        switches[some] = np.add.reduceat(change, ptr[some])
                yield pa.record_batch(
                    [ids, pa.array(text.held_out(ids.to_pylist())), pa.array(pred), pa.array(score), pa.array(words, pa.int64()), pa.array(switches, pa.int64())],
                    names=["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"],
                )

    return docs.select("doc_id", "text").mapInArrow(text.tidy(run), OUT)


def runs(docs: DataFrame, model: Model) -> DataFrame:
    """Code-switched runs of every document: doc_id, and an array of (lang, words) in text order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in text.slices(batch):
                m, ptr, c, keep = word_marginals(model, part.column("text"))
                label, words = m.argmax(1), c.words()
                out = []
                for d in range(part.num_rows):
                    row: list[dict] = []
                    for k in range(int(ptr[d]), int(ptr[d + 1])):
                        lang, word = model.langs[label[k]], words[c.codes[keep[k]]]
                        if row and row[-1]["lang"] == lang:
                            row[-1]["words"].append(word)
                        else:
                            row.append({"lang": lang, "words": [word]})
                    out.append(row)
                kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.list_(pa.string()))]))
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(out, kind)], names=["doc_id", "runs"])

    return docs.select("doc_id", "text").mapInArrow(text.tidy(run), "doc_id bigint, runs array<struct<lang:string,words:array<string>>>")


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    job.arrow_batches(spark)
    docs = job.documents(spark, sf_dir)
    return predict(docs, fit(docs))


def relabelled(model: Model | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a language, with it as lang."""
    if model is None:
        return
    for batch in batches:
        lang_at = batch.schema.get_field_index("lang")
        for part in text.slices(batch, size=job.STAGE_SLICE):
            m, ptr = word_marginals(model, part.column("text"))[:2]
            words = np.diff(ptr)
            some = np.flatnonzero(words)
            if not len(some):
                continue
            best = (np.add.reduceat(m, ptr[some], axis=0, dtype=np.float64) / words[some][:, None]).argmax(1)
            del m  # before the next slice's
            kept = part.take(pa.array(some))
            lang = pa.array([model.langs[b] for b in best.tolist()], pa.string())
            columns = [lang if i == lang_at else kept.column(i) for i in range(kept.num_columns)]
            yield pa.record_batch(columns, schema=part.schema.set(lang_at, pa.field("lang", pa.string())))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a recognisable language (``und``) go; lang becomes the
    predicted one, by a model of all rows.  Predictions are made beside the rows, so nothing is joined."""
    job.arrow_batches(spark, job.STAGE_BATCH)
    shared = spark.sparkContext.broadcast(fit_all(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from relabelled(shared.value, batches)

    return docs.mapInArrow(text.tidy(run), docs.schema)
