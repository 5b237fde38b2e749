"""Counting phrases over a corpus, and the glossary of the best ones."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import phrases
from vellum.operators.lines import split_lines
from vellum.plans import store


#: Bits of a hash that are its slice, and bits in all that are counted; bits of the table that phrases are looked up in, at most, and
#: for each phrase in it; hashes that a task collects before it sends them.
SLICE, KEY, MOST_BITS, BITS_EACH, HELD = 8, 40, 29, 16, 1 << 21


class _WordHashes(dict):
    """64-bit hashes of words, the same in every process; words are looked at once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return out


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15) + y
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(texts: list, compat: bool, known: _WordHashes) -> tuple[list[str], list[tuple[int, np.ndarray, np.ndarray]]]:
    """The eligible words, and for each length of a phrase the places of its first words among them and its hashes."""
    words, sizes = [], []
    for t in texts:
        for w in phrases.segments(split_lines(t or ""), compat):
            words += w
            sizes.append(len(w))
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    left = np.repeat(np.cumsum(sizes, dtype=np.int64), sizes) - np.arange(len(words))
    at, out = np.flatnonzero(left >= phrases.SHORTEST), []
    g = h[at]
    for k in range(1, phrases.SHORTEST):
        g = _mixed(g, h[at + k])
    for n in range(phrases.SHORTEST, phrases.LONGEST + 1):
        if n > phrases.SHORTEST:
            keep = left[at] >= n
            at = at[keep]
            g = _mixed(g[keep], h[at + n - 1])
        out.append((n, at, g))
    return words, out


def _frequent(docs: DataFrame, least: int, compat: bool) -> tuple[np.ndarray, int]:
    """A table of bits, at most 2**MOST_BITS, and how many bits of a phrase's hash are the place in it: set for all phrases that
    occur ``least`` times, and by chance for some others.  Hashes travel as 4 bytes for an occurrence, sorted into slices."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _WordHashes(), [], 0

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held) >> np.uint64(64 - KEY), return_counts=True)
            key = np.repeat(key, np.minimum(n, least))
            ends = np.searchsorted(key >> np.uint64(KEY - SLICE), np.arange((1 << SLICE) + 1))
            key = key.astype(np.uint32)  # the slice's bits go
            some = np.flatnonzero(np.diff(ends)).tolist()
            return pa.record_batch([pa.array(some, pa.int32()), pa.array([key[ends[i]:ends[i + 1]].tobytes() for i in some], pa.binary())], names=["slice", "keys"])

        for batch in batches:
            for _, _, g in _places(batch.column(0).to_pylist(), compat, known)[1]:
                held.append(g)
                size += len(g)
            if size > HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = defaultdict(list)
        for batch in batches:
            for i, raw in zip(batch.column("slice").to_pylist(), batch.column("keys").to_pylist()):
                slices[i].append(raw)
        while slices:
            i, parts = slices.popitem()
            key = np.sort(np.frombuffer(b"".join(parts), np.uint32))
            key = np.unique(key[least - 1:][key[least - 1:] == key[:len(key) - least + 1]])
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([key.tobytes()], pa.binary())], names=["slice", "keys"])

    kind = "slice int, keys binary"
    keys = docs.select("text").mapInArrow(tally, kind).repartition("slice").mapInArrow(often, kind)
    keys = store.written(keys, "phrases")
    n = keys.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    bits = min(max((n // 4 * BITS_EACH).bit_length(), SLICE + 3), MOST_BITS)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column("slice").to_pylist(), batch.column("keys").to_pylist()):
                on = np.zeros(1 << bits - SLICE, bool)
                on[np.frombuffer(raw, np.uint32) >> np.uint32(KEY - bits)] = True
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], names=["slice", "keys"])

    out = np.zeros((1 << SLICE, 1 << bits - SLICE - 3), np.uint8)
    for r in keys.mapInArrow(table, kind).toLocalIterator():
        out[r["slice"]] = np.frombuffer(r["keys"], np.uint8)
    return out.ravel(), bits


def phrase_counts(docs: DataFrame, least: int = 1, compat: bool = False) -> DataFrame:
    """(phrase, n) over all texts.  Each task counts its batches first, so that of a frequent phrase only a
    few rows travel; of phrases that don't occur ``least`` times hashes alone do, but for the few that share bits with others."""
    spark = docs.sparkSession
    store.arrow_batches(spark)
    frequent = spark.sparkContext.broadcast(_frequent(docs, least, compat) if least > 1 else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = Counter(), _WordHashes()

        def out() -> pa.RecordBatch:
            rows = pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["phrase", "n"])
            total.clear()
            return rows

        for batch in batches:
            words, found = _places(batch.column(0).to_pylist(), compat, known)
            for n, at, g in found:
                if frequent.value is not None:
                    table, bits = frequent.value
                    place = g >> np.uint64(64 - bits)
                    at = at[table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0]
                total.update(" ".join(words[i:i + n]) for i in at.tolist())
                if len(total) > 500_000:
                    yield out()
        yield out()

    df = docs.select("text").mapInArrow(count, "phrase string, n bigint").where(F.octet_length("phrase") >= phrases.LEAST_BYTES)
    return df.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def glossary(counts: DataFrame, most: int = phrases.MOST_NAMES) -> DataFrame:
    """(name, phrase, n, gross): the ``most`` phrases of the greatest gross saving with at least five occurrences."""
    gross = F.col("n") * (F.octet_length("phrase") - 2)
    best = counts.where(F.col("n") >= phrases.LEAST).withColumn("gross", gross).orderBy(F.desc("gross"), "phrase").limit(most)
    # At most ``most`` rows are numbered.
    numbered = best.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("gross"), "phrase")))
    return numbered.select(F.concat(F.lit("T"), F.col("k").cast("string")).alias("name"), "phrase", "n", "gross")


def mine(state: DataFrame, compat: bool = False) -> tuple[dict[str, str], str, str | None]:
    """The glossary of the texts (path, text) as the phrase rule sees them, the preamble, and the anchor: the document of
    the least path, which gets the preamble."""
    rows = glossary(phrase_counts(state, phrases.LEAST, compat)).collect()
    rows.sort(key=lambda r: int(r["name"][1:]))
    names = {r["phrase"]: r["name"] for r in rows}
    line = "[gloss] " + "; ".join(f"{r['name']}={r['phrase']}" for r in rows) + "\n" if rows else ""
    return names, line, state.agg(F.min("path")).first()[0]
