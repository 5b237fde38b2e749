"""Benchmark passages in documents: latent semantic search, then subsequence checks.

Words are lower-cased runs of letters and digits, hashed to ``VOCAB`` buckets and weighted by squared inverse
document frequency over all documents.  A randomised SVD of the TF-IDF passages (A'(A G) with a random
G, orthonormalised) gives a basis of ``RANK`` dimensions; it is fitted on the passages of all documents
and of the whole benchmark, which are weighted to outweigh the documents' (``OUTWEIGH`` times their norm), so that the basis
tells its items apart.  Every document is searched:
windows of about an item's length, a quarter of it apart, are projected by running sums and
compared by cosine with all items of that length.  Candidates of cosine ``COSINE`` and more are
verified on the words themselves: the longest common subsequence of the item with the window and its
surroundings (as much as half a window on each side) must cover ``COVER`` of the item, or ``COVER_ANSWER`` of it if also the item's last
``ANSWER`` words (where question items have their answers) stand there in a row.  Before that, a candidate is
dropped if too few words of the surroundings are words of the item at all, which loses nothing.

Items are the queries, all rows the searched set.  They are taken in blocks of at most ``BLOCK_ITEMS`` items and about
``BLOCK_WORDS`` words, one pass over the documents each; one block at a time is in the driver's memory and broadcast,
so neither grows with the benchmark.  An item of over ``PART`` words is cut into even parts of at most that many, which are
searched each; what their best regions in a document hold is added up, and the sum must cover as much of the item
as above.  Items of under ``MIN_WORDS`` words are matched only as a whole and in a row, by the
hashes of all runs of so many words, without the cosine.  Items without a word match nothing.

Null and empty texts match nothing.  Repeated documents and items give repeated rows.  Rows with null
doc_id are searched too.  Extra columns are ignored, or kept by ``stage``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vellum.llm import job, text

VOCAB, RANK, FIT_PASSAGE = 1 << 14, 64, 32
COSINE, COVER, COVER_ANSWER, ANSWER, MIN_WORDS = 0.78, 0.7, 0.5, 3, 8
BLOCK_ITEMS, BLOCK_WORDS = 1024, 1 << 18
OUTWEIGH = 3.0
#: Window lengths; an item is searched with the nearest one.
LENGTHS = (8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Words up to which an item is searched in one.
PART = LENGTHS[-1]
OUT = "doc_id bigint, item_id bigint, cosine double, lcs double, first_word bigint"


def _buckets(c: text.Hashed) -> np.ndarray:
    return (c.hashes % np.uint64(VOCAB)).astype(np.int64)


def document_frequency(docs: DataFrame) -> np.ndarray:
    """Documents with a word of each bucket, and in the last place documents in all."""

    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for part in text.slices(batch):
            c = text.hashed_words(part.column("text"), text.ALNUM)
            if len(c.hashes):
                key = np.sort(c.docs * VOCAB + _buckets(c))
                total[:VOCAB, 0] += np.bincount(key[np.diff(key, prepend=-1) > 0] % VOCAB, minlength=VOCAB)
            total[VOCAB, 0] += part.num_rows

    return job.summed(docs, ["text"], fill, (VOCAB + 1, 1), 4096)[:, 0]


def idf_of(df: np.ndarray) -> np.ndarray:
    """Weights of the buckets: squared, as frequent words would rule the basis otherwise."""
    return (np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1) ** 2


@cache
def _gaussian() -> np.ndarray:
    return np.random.default_rng(17).normal(size=(VOCAB, RANK)).astype(np.float32)


def _sums(rows: np.ndarray, index: np.ndarray, starts: np.ndarray, width: int = 8) -> np.ndarray:
    """Sums of rows[index] over the segments that begin at ``starts``: ``width`` at a time, then the sums of these, and so on."""
    while True:
        rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])
        size = np.diff(starts, append=len(index))
        per = -(-size // width)
        ptr = np.cumsum(per) - per
        grid = np.full(int(per.sum()) * width, len(rows) - 1)
        grid[np.arange(len(index)) + np.repeat(ptr * width - starts, size)] = index
        grid = grid.reshape(-1, width)
        out = np.empty((len(grid), rows.shape[1]), np.float32)
        for i in range(0, len(grid), 512):
            some, part = np.ascontiguousarray(grid[i:i + 512].T), out[i:i + 512]
            np.take(rows, some[0], axis=0, out=part, mode="clip")
            for k in range(1, width):
                part += np.take(rows, some[k], axis=0, mode="clip")
        if per.max() <= 1:
            return out
        rows, index, starts = out, np.arange(len(out)), ptr


def _sketch(total: np.ndarray, buckets: np.ndarray, passage: np.ndarray, idf: np.ndarray, g: np.ndarray) -> None:
    """Adds A'(A G) of unit-length passages to ``total`` [VOCAB, RANK].  g: the rows of G times ``idf``."""
    if not len(buckets):
        return
    n = int(passage[-1]) + 1
    key = np.sort(passage * VOCAB + buckets)
    at = np.flatnonzero(np.diff(key, prepend=-1))
    w = np.diff(at, append=len(key)) * idf[key[at] % VOCAB]
    square = np.bincount(key[at] // VOCAB, w * w, n)
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    own = passage[first]
    y = np.zeros((n, RANK), np.float32)
    y[own] = _sums(g, buckets, first) / square[own][:, None]
    order = np.argsort(buckets.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.diff(buckets[order], prepend=-1))
    own = buckets[order[first]]
    total[own] += _sums(y, passage[order], first) * idf[own][:, None]


def _passages(c: text.Hashed) -> np.ndarray:
    """Number of the passage of each word: passages don't span documents."""
    size = np.diff(c.ptr)
    per = -(-size // FIT_PASSAGE)
    start = np.cumsum(per) - per
    doc = c.docs
    within = np.arange(len(doc)) - c.ptr[:-1][doc]
    return start[doc] + within // FIT_PASSAGE


def fit(docs: DataFrame, benchmark: DataFrame, df: np.ndarray) -> np.ndarray:
    """[VOCAB, RANK]: a word's weighted place in the latent space."""
    idf = idf_of(df)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        g = (_gaussian() * shared.value[:, None]).astype(np.float32)
        for part in text.slices(batch, size=2_000_000):
            c = text.hashed_words(part.column("text"), text.ALNUM)
            _sketch(total, _buckets(c), _passages(c), shared.value, g)

    total = job.summed(docs, ["text"], fill, (VOCAB, RANK), 512)
    own = job.summed(benchmark, ["text"], fill, (VOCAB, RANK), 512)
    weight = OUTWEIGH * np.linalg.norm(total) / max(np.linalg.norm(own), 1e-12) if total.any() else 1.0
    q, _ = np.linalg.qr(total + weight * own)
    return (q * idf[:, None]).astype(np.float32)


@dataclass
class Queries:
    ids: list[int]
    words: list[list[int]]  # hashes, of each unit: an item, or a part of a long one
    item: list[int]  # the units' items
    size: list[int]  # the items' words
    short: dict[int, dict[int, list[int]]]  # words, hash of the whole, items
    latent: np.ndarray  # [VOCAB + 1, RANK], the last row zero
    groups: list[tuple[int, np.ndarray, np.ndarray]]  # window length, units, unit vectors [RANK, units]
    vocab: np.ndarray  # sorted hashes of the units' words
    held: np.ndarray  # sorted unit * (vocab + 1) + word, of each unit's words
    need: np.ndarray  # words of a matching region that are the unit's, at least


def queries(items: list[tuple[int, str]], latent: np.ndarray) -> Queries:
    c = text.hashed_words(pa.array([t for _, t in items], pa.large_string()), text.ALNUM)
    b = _buckets(c)
    full = [int(n) for n in np.diff(c.ptr)]
    cut, short = [], {}
    for i, n in enumerate(full):
        at = int(c.ptr[i])
        if 0 < n < MIN_WORDS:
            short.setdefault(n, {}).setdefault(int(_runs(c.hashes[at:at + n], n)[0]), []).append(i)
        parts = max(1, -(-n // PART))
        cut += [(i, at + n * k // parts, at + n * (k + 1) // parts) for k in range(parts)]
    item = [i for i, _, _ in cut]
    words, vec = [c.hashes[s:e].tolist() for _, s, e in cut], np.zeros((len(cut), RANK), np.float32)
    for u, (_, s, e) in enumerate(cut):
        vec[u] = latent[b[s:e]].sum(0)
    vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
    size = np.array([len(w) for w in words])
    near = np.abs(np.log(np.maximum(size, 1))[:, None] - np.log(LENGTHS)[None]).argmin(1) if len(cut) else np.zeros(0, int)
    groups = []
    for k, length in enumerate(LENGTHS):
        own = np.flatnonzero((near == k) & (size > 0) & (np.array([full[i] for i in item]) >= MIN_WORDS))
        if len(own):
            groups.append((length, own, np.ascontiguousarray(vec[own].T)))
    vocab, place = np.unique(c.hashes, return_inverse=True)
    held = [np.unique(place[s:e]) + u * (len(vocab) + 1) for u, (_, s, e) in enumerate(cut)]
    # A part of a long item may hold little, if others hold more.
    need = np.array([int(np.ceil(COVER_ANSWER * len(w))) if len(w) == full[i] else 1 for i, w in zip(item, words)], np.int64)
    wide = np.vstack([latent, np.zeros((1, RANK), np.float32)])
    return Queries([i for i, _ in items], words, item, full, short, wide, groups, vocab, np.concatenate([np.zeros(0, np.int64), *held]), need)


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, from the words' hashes."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = text.mix64(out + h[k:k + len(out)], k)
    return out


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = where.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _in_a_row(part: list, whole: list) -> bool:
    n = len(part)
    return any(whole[i:i + n] == part for i in range(len(whole) - n + 1))


def verify(item: list, region: list) -> float:
    """The share of the item in a common subsequence with the region, or 0 if that isn't enough."""
    n = len(item)
    if n < MIN_WORDS:
        return 1.0 if _in_a_row(item, region) else 0.0
    share = lcs(item, region) / n
    if share >= COVER or (share >= COVER_ANSWER and _in_a_row(item[-ANSWER:], region)):
        return share
    return 0.0


def search(q: Queries, col: pa.Array, chunk: int = 16_000) -> list[tuple[int, int, float, float, int]]:
    """(row, item, cosine, share, first word) of the best match of each matching row and item."""
    c = text.hashed_words(col, text.ALNUM)
    if not len(c.hashes) or not (q.groups or q.short):
        return []
    found: dict[tuple[int, int], tuple[float, float, int]] = {}
    parts: dict[tuple[int, int], tuple[int, float, int, bool]] = {}
    if q.short:
        _search_short(q, c, found)
    bucket = _buckets(c)
    n_docs = len(c.ptr) - 1
    d = 0
    while d < n_docs and q.groups:
        # Whole documents, about ``chunk`` words; a longer document is taken in overlapping pieces.
        to = max(d + 1, int(np.searchsorted(c.ptr, c.ptr[d] + chunk, "right")) - 1)
        a, z = int(c.ptr[d]), int(c.ptr[to])
        pieces = [(a, z)] if z - a <= chunk or to > d + 1 else [(s, min(z, s + chunk)) for s in range(a, z, chunk - 2 * PART)]
        for s, e in pieces:
            _search(q, c, bucket, s, e, d, to, found, parts)
        d = to
    long: dict[tuple[int, int], list[tuple[int, float, int, bool]]] = {}
    for (row, unit), best in parts.items():
        long.setdefault((row, q.item[unit]), []).append(best)
    for (row, item), best in long.items():
        share = sum(n for n, *_ in best) / q.size[item]
        if share >= COVER or (share >= COVER_ANSWER and any(answer for *_, answer in best)):
            found[row, item] = (max(cos for _, cos, *_ in best), share, min(first for *_, first, _ in best))
    return [(r, i, *v) for (r, i), v in sorted(found.items())]


def _search_short(q: Queries, c: text.Hashed, found: dict) -> None:
    """Items of few words: equal runs, in place of cosines."""
    with np.errstate(over="ignore"):
        h, doc = c.hashes, c.docs
        for n, by_hash in q.short.items():
            run = _runs(h, n)
            for at in np.flatnonzero(np.isin(run, np.array(list(by_hash), np.uint64)) & (doc[:len(run)] == doc[n - 1:])).tolist():
                row = int(doc[at])
                for item in by_hash[int(run[at])]:
                    if (row, item) not in found and h[at:at + n].tolist() == q.words[q.item.index(item)]:
                        found[row, item] = (1.0, 1.0, at - int(c.ptr[row]))


def _search(q: Queries, c: text.Hashed, bucket: np.ndarray, s: int, e: int, d0: int, d1: int, found: dict, parts: dict) -> None:
    """Searches words s to e, which are of documents d0 to d1, for all groups."""
    starts = np.clip(c.ptr[d0:d1], s, e) - s
    ends = np.clip(c.ptr[d0 + 1:d1 + 1], s, e) - s
    # Sums of ``grain`` words, from each document's start on, and their running sums.
    grain = 4 if q.groups[0][0] >= 16 else 2
    cells = -(-(ends - starts) // grain)
    cell_ptr = np.concatenate([[0], np.cumsum(cells)])
    padded = np.full(int(cell_ptr[-1]) * grain, VOCAB)
    padded[np.arange(e - s) + np.repeat(cell_ptr[:-1] * grain - starts, ends - starts)] = bucket[s:e]
    x = np.take(q.latent, padded, axis=0)
    part = x[0::grain] + x[1::grain]
    for k in range(2, grain):
        part += x[k::grain]
    run = np.zeros((len(part) + 1, RANK), np.float32)
    np.cumsum(part, axis=0, out=run[1:])
    for length, units, vectors in q.groups:
        wide, step = length // grain, max(1, length // grain // 4)
        per = np.where(cells > wide, -(-(cells - wide) // step) + 1, (cells > 0).astype(np.int64))
        doc = np.repeat(np.arange(len(cells)), per)
        at = cell_ptr[:-1][doc] + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * step
        w = np.take(run, np.minimum(at + wide, cell_ptr[1:][doc]), axis=0)
        w -= np.take(run, at, axis=0)
        norm = np.sqrt(np.maximum(np.einsum("ij,ij->i", w, w), 1e-18))
        dot = w @ vectors
        hit = np.flatnonzero(dot >= (np.float32(COSINE) * norm)[:, None])
        if not len(hit):
            continue
        i, j = hit // len(units), hit % len(units)
        unit, row = units[j], doc[i]
        first = starts[row] + (at[i] - cell_ptr[:-1][row]) * grain
        left = np.maximum(starts[row], first - length // 2)
        right = np.minimum(ends[row], first + length + length // 2)
        grid = left[:, None] + np.arange(2 * length)[None]
        inside = grid < right[:, None]
        near = c.hashes[s + np.where(inside, grid, 0)]
        word = np.minimum(np.searchsorted(q.vocab, near), len(q.vocab) - 1)
        key = np.where(q.vocab[word] == near, word, len(q.vocab)) + unit[:, None] * (len(q.vocab) + 1)
        place = np.minimum(np.searchsorted(q.held, key), len(q.held) - 1)
        enough = ((q.held[place] == key) & inside).sum(1) >= q.need[unit]
        for x, r, u, lo, hi in zip((dot[i, j] / norm[i])[enough].tolist(), row[enough].tolist(), unit[enough].tolist(), left[enough].tolist(), right[enough].tolist()):
            _verify(q, c, d0 + r, u, x, s + lo, s + hi, found, parts)


def _verify(q: Queries, c: text.Hashed, row: int, unit: int, cos: float, lo: int, hi: int, found: dict, parts: dict) -> None:
    """Keeps the best region of each document and item, or part of a long item."""
    item, region, at = q.item[unit], c.hashes[lo:hi].tolist(), lo - int(c.ptr[row])
    if q.size[item] > PART:
        last = unit + 1 == len(q.item) or q.item[unit + 1] != item
        n, old = lcs(q.words[unit], region), parts.get((row, unit), (0, 0.0, 0, False))
        answer = old[3] or (last and _in_a_row(q.words[unit][-ANSWER:], region))
        parts[row, unit] = (*((n, cos, at) if (n, cos) > old[:2] else old[:3]), answer)
        return
    share = verify(q.words[unit], region)
    old = found.get((row, item))
    if share and (old is None or (share, cos) > (old[1], old[0])):
        found[row, item] = (cos, share, at)


def _blocks(benchmark: DataFrame, latent: np.ndarray) -> Iterator[Queries]:
    """The items, sorted, in blocks of bounded size."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        size = len(r["text"] or "") // 4
        if block and (len(block) == BLOCK_ITEMS or held + size > BLOCK_WORDS):
            yield queries(block, latent)
            block, held = [], 0
        block.append((r["item_id"], r["text"] or ""))
        held += size
    if block:
        yield queries(block, latent)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it holds; rows of documents without any are absent.  Several blocks of
    items are written one by one."""
    spark = docs.sparkSession
    latent = fit(docs, benchmark, document_frequency(docs))

    def one(q: Queries) -> DataFrame:
        shared = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text.slices(batch):
                    rows = search(shared.value, part.column("text"))
                    if rows:
                        ids = part.column("doc_id").to_pylist()
                        r, i, cos, share, first = zip(*rows)
                        yield pa.record_batch(
                            [pa.array([ids[k] for k in r], pa.int64()), pa.array([shared.value.ids[k] for k in i], pa.int64()),
                             pa.array(cos, pa.float64()), pa.array(share, pa.float64()), pa.array(first, pa.int64())],
                            names=["doc_id", "item_id", "cosine", "lcs", "first_word"],
                        )

        return docs.select("doc_id", "text").mapInArrow(text.tidy(run), OUT)

    out, last = None, None
    for q in _blocks(benchmark, latent):
        if last is not None:  # not the last one
            done = job.written(last, "decontam-block")
            out = done if out is None else out.unionByName(done)
        last = one(q)
    if last is None:
        return spark.createDataFrame([], OUT)
    return last if out is None else out.unionByName(job.written(last, "decontam-block"))


def op8_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    job.arrow_batches(spark)
    return matches(job.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark passage go."""
    job.arrow_batches(spark, job.STAGE_BATCH)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    latent = fit(docs, benchmark, document_frequency(docs))

    def without(left: DataFrame, q: Queries) -> DataFrame:
        shared = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text.slices(batch, size=job.STAGE_SLICE):
                    bad = {r for r, *_ in search(shared.value, part.column("text"))}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        return left.mapInArrow(text.tidy(run), docs.schema)

    left, first = docs, True
    for q in _blocks(benchmark, latent):
        left = without(left if first else job.written(left, "decontam-block"), q)
        first = False
    return left
