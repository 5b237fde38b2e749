"""Near duplicates by random bit sampling of SimHash signatures.

A text's signature has 512 bits: 256 of its set of distinct words (runs of letters, lower-cased in
ASCII) and 256 of that set joined with the set of its word pairs.  Two texts are near duplicates if
their first halves differ in at most ``near`` bits and the whole in at most ``near_all``.

Candidates come from hash tables keyed by sampled coordinates of the first half.  Tables stand in groups:
those of a group share some ``shared`` coordinates and have ``OWN_BITS`` of their own, ``IN_GROUP`` tables each.  A
signature is sent once per group, to the bucket of the shared coordinates, where the tables are made by sorting.
There are as many groups as make two signatures at the limit ``near`` meet with probability 0.9 (``RECALL``) or more
(``chance``); it is over 0.99 up to 24 bits, and transitive links find most of the rest.  A larger input has more shared
coordinates, so that buckets don't grow, and for that more groups, so that recall doesn't fall: 10 up to
4 million signatures, 43 at a billion.

A bucket of over ``cap`` signatures is sent on to one bucket for each table, by the additional bits of that
table.  Buckets of a table over ``dense`` signatures are cut into blocks, and each pair of blocks is one task's work.  So
no candidate is lost, and a task holds at most ``cap`` signatures.  Every candidate's distance is
verified; a pair counts in the first table that has it.  Equal texts and equal signatures are merged
before any comparison, so groups of copies cost nothing, and pairs leave a task as a spanning forest plus a count for each node.

Null texts and texts without a word form no near duplicates; equal texts (empty ones too) are one
group, nulls are groups of their own (equal ids together).  Repeated rows are copies, of whatever ids: a doc_id may repeat
with other texts.  The class_id of a group without any doc_id is null.  Extra columns are ignored, or kept by ``stage``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import graph, job, text

OWN_BITS, IN_GROUP, LEAST_SHARED, MEAN_BUCKET, RECALL = 8, 8, 8, 1 << 14, 0.9
CAP, DENSE, NEAR, NEAR_ALL = 1 << 17, 1 << 13, 40, 100
#: Copies of a text from which its rows are joined by broadcast.
HOT = 100_000
_SEED = 20_240_229


def signatures(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """uint64[n, 8] and whether a text has a word."""
    c = text.hashed_words(col)
    n = len(col)
    out = np.zeros((n, 8), np.uint64)
    size = np.diff(c.ptr)
    if not len(c.hashes):
        return out, size > 0
    doc = c.docs
    # A feature is its document and 40 bits of hash in one number, so that one sort finds the distinct ones.
    word_doc, word = _distinct(doc, c.hashes)
    same = doc[1:] == doc[:-1]
    with np.errstate(over="ignore"):
        pair = text.mix64(c.hashes[:-1] * np.uint64(3) + c.hashes[1:], 9)[same]
    pair_doc, pair = _distinct(doc[1:][same], pair)
    own = _sums(word_doc, word, n, 4)
    out[:, :4] = _pack(_sums(word_doc, word, n, 0))
    out[:, 4:] = _pack(own + _sums(pair_doc, pair, n, 4))
    return out, size > 0


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(doc.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    key = key[np.diff(key, prepend=key[:1] + np.uint64(1)) != 0] if len(key) else key
    return (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)


#: For each byte value, its eight bits as eight counters of one byte, the first bit in the first byte.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _sums(doc: np.ndarray, h: np.ndarray, n: int, seed: int, step: int = 65_536) -> np.ndarray:
    """For each document (sorted), for each of 256 bits, features with that bit less those without.
    Up to 255 features are added in packed one-byte counters, then their totals."""
    out = np.zeros((n, 256), np.int32)
    for at in range(0, len(h), step):
        d, x = doc[at:at + step], h[at:at + step]
        first = np.flatnonzero(np.diff(d, prepend=-1))
        size = np.diff(np.append(first, len(d)))
        parts = -(-size // 255)
        cut = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        raw = np.stack([text.mix64(x, seed + k) for k in range(4)], axis=1).view(np.uint8)
        counts = np.add.reduceat(_SPREAD[raw], cut, axis=0).view(np.uint8)
        ones = np.add.reduceat(counts, np.cumsum(parts) - parts, axis=0, dtype=np.int32)
        out[d[first]] += 2 * ones - size[:, None].astype(np.int32)
    return out


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64)


@dataclass(frozen=True)
class Tables:
    """Sampled coordinates (of the first 256): shared[g] of each group, own[g][u] of each of its tables."""

    shared: list[np.ndarray]
    own: list[list[np.ndarray]]

    def shared_keys(self, bits: np.ndarray) -> np.ndarray:
        """int64[n, groups]: the shared bits of each group, mixed with the group's number."""
        return np.stack([text.mix64(_number(bits, s), 100 + g) for g, s in enumerate(self.shared)], axis=1).view(np.int64)

    def own_keys(self, bits: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The own bits of each row's table t (group * IN_GROUP + number in the group)."""
        places = np.array(self.own).reshape(-1, OWN_BITS)[t]
        return np.packbits(bits[np.arange(len(bits))[:, None], places], axis=1)[:, 0]

    def met_before(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For pairs with differences x [n, 4] that share table t: whether an earlier table has them too."""
        g, u = t // IN_GROUP, t % IN_GROUP
        met = np.zeros(len(x), bool)
        left = np.arange(len(x))
        for k in range(int(g.max(initial=-1)) + 1):
            left = left[~met[left] & (g[left] >= k)]
            if not len(left):
                break
            at = left[~(x[left] & _mask(self.shared[k])).any(axis=1)]
            for v in range(IN_GROUP):
                if not len(at):
                    break
                at = at[(g[at] > k) | (u[at] > v)]
                hit = ~(x[at] & _mask(self.own[k][v])).any(axis=1)
                met[at[hit]] = True
                at = at[~hit]
        return met


def _mask(sample: np.ndarray) -> np.ndarray:
    on = np.zeros(256, np.uint8)
    on[sample] = 1
    return np.packbits(on).view(np.uint64)


def _number(bits: np.ndarray, sample: np.ndarray) -> np.ndarray:
    value = np.zeros(len(bits), np.uint64)
    for b in sample:
        value = (value << np.uint64(1)) | bits[:, b]
    return value


def _bits(sig: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(sig[:, :4]).view(np.uint8), axis=1)


def chance(shared: int, groups: int, d: int) -> float:
    """Of two signatures at distance d to meet in some table."""
    left = 256 - shared
    own = math.comb(left - d, OWN_BITS) / math.comb(left, OWN_BITS)
    return 1 - (1 - math.comb(256 - d, shared) / math.comb(256, shared) * (1 - (1 - own) ** IN_GROUP)) ** groups


def tables_for(n: int, near: int = NEAR) -> Tables:
    """Tables for n signatures: buckets of about MEAN_BUCKET, and RECALL at distance ``near`` whatever n is."""
    shared = max(LEAST_SHARED, math.ceil(math.log2(max(n, 1) / MEAN_BUCKET)))
    groups = 1
    while chance(shared, groups, near) < RECALL:
        groups += 1
    rng = np.random.default_rng(_SEED)
    order = [rng.permutation(256) for _ in range(groups)]
    # A table's own bits don't repeat the shared ones.
    return Tables([o[:shared] for o in order], [[rng.permutation(o[shared:])[:OWN_BITS] for _ in range(IN_GROUP)] for o in order])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def sorted_pairs(key: np.ndarray, part: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of equal keys, in parts; the keys are sorted."""
    live, k = np.arange(len(key)), 1
    while len(live):
        live = live[live + k < len(key)]
        live = live[key[live + k] == key[live]]
        for at in range(0, len(live), part):
            yield live[at:at + part], live[at:at + part] + k
        k += 1


def block_pairs(sig: np.ndarray, first: int | None, near: int, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs i < j of rows, in parts; if ``first`` is given, of one of the first so many with one of the others."""
    for a in range(0, len(sig) if first is None else first, step):
        to = min(a + step, len(sig) if first is None else first)
        for b in range(a if first is None else first, len(sig), step):
            i, j = np.nonzero(distance(sig[a:to, None, :4], sig[None, b:b + step, :4]) <= near)
            k = i + a < j + b
            yield i[k] + a, j[k] + b


class Links:
    """Collects verified pairs of buckets: links of each row, and a spanning forest."""

    def __init__(self, table: pa.Table, tables: Tables, near: int, near_all: int):
        self.sig, self.node, self.weight = _matrix(table["sig"]), table["node"].to_numpy(), table["n_texts"].to_numpy()
        self.tables, self.near, self.near_all = tables, near, near_all
        self.n, self.parent, self.edges = np.zeros(len(self.sig), np.int64), {}, []

    def add(self, i: np.ndarray, j: np.ndarray, t: np.ndarray) -> None:
        """Pairs of rows, and the tables that they met in."""
        near = distance(self.sig[i, :4], self.sig[j, :4]) <= self.near
        i, j, t = i[near], j[near], t[near]
        near = distance(self.sig[i], self.sig[j]) <= self.near_all
        i, j, t = i[near], j[near], t[near]
        if len(i):
            new = ~self.tables.met_before(self.sig[i, :4] ^ self.sig[j, :4], t)
            i, j = i[new], j[new]
            np.add.at(self.n, i, self.weight[j])
            np.add.at(self.n, j, self.weight[i])
            self.edges.append(forest(i, j, self.parent))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(u, null, links) of nodes, and (u, v, 0) of edges."""
        some = np.flatnonzero(self.n)
        if len(some):
            a, b = (np.concatenate(x) for x in zip(*self.edges))
            size = len(some) + len(a)
            yield _out(
                size, u=pa.array(np.concatenate([self.node[some], self.node[a]])), n=pa.array(np.concatenate([self.n[some], np.zeros(len(a), np.int64)])),
                v=pa.array(np.concatenate([np.zeros(len(some), np.int64), self.node[b]]), mask=np.arange(size) < len(some)),
            )


#: What a comparison gives: links (u, v, n), or signatures for the next level (key, table, block and the signature).
_FIELDS = {"u": pa.int64(), "v": pa.int64(), "n": pa.int64(), "key": pa.int64(), "t": pa.int32(), "block": pa.int64(), "node": pa.int64(), "n_texts": pa.int64(), "sig": pa.binary()}
_KIND = "u bigint, v bigint, n bigint, key bigint, t int, block bigint, node bigint, n_texts bigint, sig binary"


def _out(size: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([columns[f] if f in columns else pa.nulls(size, kind) for f, kind in _FIELDS.items()], names=list(_FIELDS))


def _onwards(table: pa.Table, rows: np.ndarray, key: np.ndarray, t: np.ndarray, block: np.ndarray | None) -> pa.RecordBatch:
    part = {c: table[c].combine_chunks().take(pa.array(rows)) for c in ("node", "n_texts", "sig")}
    if block is not None:
        part["block"] = pa.array(block, pa.int64())
    return _out(len(rows), key=pa.array(key, pa.int64()), t=pa.array(t, pa.int32()), **part)


def forest(i: np.ndarray, j: np.ndarray, parent: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that the pairs add to the spanning forest of ``parent``."""

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    keep = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
            keep.append(k)
    return i[keep], j[keep]


def _matrix(col: pa.Array) -> np.ndarray:
    raw, _ = text.buffers(col)
    return np.ascontiguousarray(raw).view(np.uint64).reshape(-1, 8)


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    raw, _ = text.buffers(col)
    return np.ascontiguousarray(raw).view(np.uint64).reshape(-1, 8)


def groups_of(batches: Iterator[pa.RecordBatch], key: str, cap: int) -> Iterator[tuple[pa.Table, int | None]]:
    """From batches that are sorted by ``key``: tables of whole groups, with None, and groups of over ``cap`` rows by
    themselves, in parts, each with the number that its first row has in the group."""
    held: list[pa.RecordBatch] = []
    size = passed = 0
    current = None

    def parts(groups: pa.RecordBatch) -> Iterator[tuple[pa.Table, int | None]]:
        k = groups.column(key).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
        n, at = np.diff(np.append(first, len(k))), 0
        for f, m in zip(first[n > cap].tolist(), n[n > cap].tolist()):
            if f > at:
                yield pa.Table.from_batches([groups.slice(at, f - at)]), None
            yield pa.Table.from_batches([groups.slice(f, m)]), 0
            at = f + m
        if at < len(k):
            yield pa.Table.from_batches([groups.slice(at)]), None

    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        own = int(np.searchsorted(k, current, "right")) if current is not None and k[0] == current else 0
        if own:
            held.append(batch.slice(0, own))
            size += own
        if own < len(k):
            if held:
                yield pa.Table.from_batches(held), passed if passed or size > cap else None
            cut = int(np.searchsorted(k, k[-1], "left"))
            if cut > own:
                yield from parts(batch.slice(own, cut - own))
            held, size, passed, current = [batch.slice(cut)], len(k) - cut, 0, k[-1]
        elif size > cap:
            yield pa.Table.from_batches(held), passed
            held, passed, size = [], passed + size, 0
    if held:
        yield pa.Table.from_batches(held), passed if passed or size > cap else None


def in_groups(table: pa.Table, tables: Tables, dense: int, near: int, near_all: int) -> Iterator[pa.RecordBatch]:
    """Links of whole buckets of shared bits.  What falls into a dense bucket of a table goes on in blocks."""
    links = Links(table, tables, near, near_all)
    bits, key, g = _bits(links.sig), table["key"].to_numpy(), table["t"].to_numpy().astype(np.int64)
    bucket = np.cumsum(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    for u in range(IN_GROUP):
        t = g * IN_GROUP + u
        own = tables.own_keys(bits, t)
        both = bucket << 8 | own
        order = np.argsort(both, kind="stable")
        both = both[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        size = np.diff(np.append(first, len(both)))
        few = np.repeat(size <= dense, size)
        live = order[few]
        for i, j in sorted_pairs(both[few]):
            i, j = live[i], live[j]
            links.add(i, j, t[i])
        for f, n in zip(first[size > dense].tolist(), size[size > dense].tolist()):
            rows = order[f:f + n]
            yield _onwards(table, rows, _next_key(key[rows], t[rows], own[rows]), t[rows], np.arange(n) // dense)
    yield from links.rows()


def _next_key(key: np.ndarray, t: np.ndarray, own: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return text.mix64(text.mix64(key.view(np.uint64), 7) + t.astype(np.uint64) * np.uint64(256) + own).view(np.int64)


def _distributed(frame: DataFrame, key: str, fn) -> DataFrame:
    return frame.repartition(key).sortWithinPartitions(key).mapInArrow(text.tidy(fn), _KIND)


def links_of(nodes: DataFrame, tables: Tables, cap: int, dense: int, near: int, near_all: int) -> DataFrame:
    """From nodes (node, n_texts, sig), written: (u, null, links) and (u, v, 0) for the links of all nodes."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_groups = len(tables.shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                keys = tables.shared_keys(_bits(_matrix(part.column("sig"))))
                for g in range(n_groups):
                    yield pa.record_batch(
                        [pa.array(keys[:, g]), pa.array(np.full(part.num_rows, g, np.int32)), *(part.column(c) for c in ("node", "n_texts", "sig"))],
                        names=["key", "t", "node", "n_texts", "sig"],
                    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in groups_of(batches, "key", cap):
            if number is None:
                yield from in_groups(table, tables, dense, near, near_all)
                continue
            bits, key, g = _bits(_matrix(table["sig"])), table["key"].to_numpy(), table["t"].to_numpy().astype(np.int64)
            for u in range(IN_GROUP):
                t = g * IN_GROUP + u
                yield _onwards(table, np.arange(len(key)), _next_key(key, t, tables.own_keys(bits, t)), t, None)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in groups_of(batches, "key", dense):
            key, t = table["key"].to_numpy(), table["t"].to_numpy().astype(np.int64)
            if number is None:
                links = Links(table, tables, near, near_all)
                for i, j in sorted_pairs(key):
                    links.add(i, j, t[i])
                yield from links.rows()
            else:
                yield _onwards(table, np.arange(len(key)), key, t, (number + np.arange(len(key))) // dense)

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in groups_of(batches, "unit", 1 << 62):
            unit = table["unit"].to_numpy()
            for a, z in zip(at := np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]).tolist(), [*at[1:], len(unit)]):
                own = table.slice(a, z - a).sort_by("block")
                block, t = own["block"].to_numpy(), own["t"].to_numpy().astype(np.int64)
                links = Links(own, tables, near, near_all)
                # Two blocks' own pairs are other units' work.
                for i, j in block_pairs(links.sig, None if block[0] == block[-1] else int(np.searchsorted(block, block[-1])), near):
                    links.add(i, j, t[i])
                yield from links.rows()

    keys = nodes.mapInArrow(text.tidy(keyed), "key bigint, t int, node bigint, n_texts bigint, sig binary")
    one = job.written(_distributed(keys, "key", first), "simhash-links")
    links = [one]
    large = one.where("key is not null and block is null").select("key", "t", "node", "n_texts", "sig")
    two = None
    if not large.isEmpty():
        two = job.written(_distributed(large, "key", second), "simhash-links")
        links.append(two)
    blocks = [x.where("block is not null").select("key", "t", "block", "node", "n_texts", "sig") for x in links]
    blocks = blocks[0] if two is None else blocks[0].unionByName(blocks[1])
    if not blocks.isEmpty():
        last = job.written(blocks.groupBy("key").agg(F.max("block").alias("last")), "simhash-blocks")
        other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
        units = blocks.join(job.maybe_broadcast(last), "key").select("*", other)
        units = units.withColumn("unit", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
        links.append(job.written(_distributed(units.drop("other", "last"), "unit", third), "simhash-links"))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.where("u is not null").select("u", "v", "n")


def signed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, a digest that equal texts share, and the signature (null without a word); written."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                sig, has = signatures(part.column("text"))
                raw = np.ascontiguousarray(sig[has]).view(np.uint8).ravel()
                off = np.concatenate([[0], np.cumsum(has)]) * 64
                col = pa.array([v if k else None for v, k in zip(text.as_array(raw, off).to_pylist(), has)], pa.binary())
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), part.column("digest"), col], names=["doc_id", "digest", "sig"])

    signed = docs.select("doc_id", "text", _digest(F.col("doc_id"), F.col("text")).alias("digest"))
    return job.written(signed.mapInArrow(text.tidy(sign), "doc_id bigint, digest binary, sig binary"), "simhash")


def _digest(doc_id: Column, text: Column) -> Column:
    return F.coalesce(F.unhex(F.md5(text)), F.concat(F.lit("null "), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def classes(signed: DataFrame, cap: int = CAP, dense: int = DENSE, near: int = NEAR, near_all: int = NEAR_ALL, tables: Tables | None = None) -> DataFrame:
    """One row per distinct text: digest, class_id, n_links, n_copies, and the digest of its class's first text."""
    # Distinct texts, then distinct signatures; both are aggregated before any shuffle.
    distinct = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"))
    distinct = job.written(distinct, "simhash-texts")
    nodes = distinct.where("sig is not null").groupBy("sig").agg(F.count("*").alias("n_texts"))
    nodes = job.written(nodes.select(F.monotonically_increasing_id().alias("node"), "n_texts", "sig"), "simhash-nodes")
    links = links_of(nodes, tables or tables_for(nodes.count(), near), cap, dense, near, near_all)
    degree = links.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    comp = graph.components(links.where("v is not null").select("u", "v"), "simhash-components")
    nodes = nodes.join(degree, "node", "left").join(comp, "node", "left").select(
        "sig", (F.coalesce("n", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"),
        F.coalesce("root", F.when(F.col("n_texts") > 1, F.col("node"))).alias("root"),  # null for a text alone
    )
    texts = job.written(distinct.join(nodes, "sig", "left").drop("sig"), "simhash-classed")
    best = texts.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "digest")).alias("best"))
    best = job.written(best.select("root", F.col("best.rep").alias("class_id"), F.col("best.digest").alias("first")), "simhash-first")
    alone = F.col("root").isNull()
    return texts.join(job.maybe_broadcast(best), "root", "left").select(
        "digest", F.when(alone, F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "n_copies", F.when(alone, F.col("digest")).otherwise(F.col("first")).alias("first"),
    )


def groups(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): class_id, the least doc_id of its group;
    n_links, the other distinct texts within the distances; n_copies, rows of the same text."""
    signed = signed_texts(docs)
    by_text = job.written(classes(signed, **options), "simhash-classes")
    rows = signed.select("doc_id", "digest")
    columns = ["doc_id", "class_id", "n_links", "n_copies"]
    often = by_text.where(F.col("n_copies") >= HOT)
    if often.isEmpty():
        return rows.join(by_text, "digest").select(columns)
    # Texts of many rows are few; their rows stay where they are.
    often = job.written(often, "simhash-hot")
    rest = rows.join(F.broadcast(often.select("digest")), "digest", "left_anti").join(by_text.where(F.col("n_copies") < HOT), "digest")
    return rows.join(F.broadcast(often), "digest").select(columns).unionByName(rest.select(columns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    job.arrow_batches(spark)
    return groups(job.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, that of the least id of the class's first text (a null id comes
    last).  Of rows that repeat as they are, by id and text, one stays."""
    job.arrow_batches(spark)
    signed = signed_texts(docs.select("doc_id", "text"))
    by_text = job.written(classes(signed), "simhash-classes")
    # Of each distinct text the least id, and how often that occurs; then what isn't the first text, or not that id.
    ids = signed.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    least = signed.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("least"))
    ids = ids.join(least, "digest").join(by_text.select("digest", "first"), "digest")
    stays = (F.col("digest") == F.col("first")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    marks = ids.select(F.col("digest").alias("digest_"), F.col("doc_id").alias("id_"), F.when(~stays, "gone").when(F.col("n") > 1, "again").alias("mark_"))
    marks = job.written(marks.where("mark_ is not null"), "simhash-marks")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    work = docs.select(row, _digest(F.col("doc_id"), F.col("text")).alias("digest_"), F.col("doc_id").cast("bigint").alias("id_"))
    key = [F.col("w.digest_") == F.col("m.digest_"), F.col("w.id_").eqNullSafe(F.col("m.id_"))]
    marked = work.alias("w").join(job.maybe_broadcast(marks).alias("m"), key, "left").select("row_", "w.digest_", "w.id_", "mark_")
    out = marked.where("mark_ is null").select("row_")
    if not marks.where("mark_ = 'again'").isEmpty():
        out = out.unionByName(marked.where("mark_ = 'again'").dropDuplicates(["digest_", "id_"]).select("row_"))
    return out.select(*[F.col(f"row_.`{c}`").alias(c) for c in docs.columns])
