"""Hierarchical weighted hash tree: which shard, rack and region a document belongs to.

At each level every child draws ln(u) / weight, u being uniform in (0, 1) and made of the md5 of the
document's key and the child's name; the largest draw wins.  A child's weight is the sum of the
weights below it.  A changed weight moves documents only into or out of the subtrees whose weights
changed: all other draws stay as they were.  A new shard gets a region and rack of its own, so that it
takes documents only into itself (law ``key``).

Slots are gapless from 0 in each shard without sorting a shard in one task: documents of a shard fall
into ``SLOT_BUCKETS`` buckets by hash, a running sum over the bucket counts (at most SLOT_BUCKETS rows
a shard, whatever the input) gives each bucket's first slot, and rows are numbered within buckets.

Only DataFrame functions run.  A null doc_id is a key of its own (the empty text), a null text has
size 1 and CRC 0.  Rows with equal keys go to the same shard; repeated rows get a slot each.  Extra
columns are ignored.  A table without rows gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import job

BASE_SHARDS, PER_RACK, RACKS_PER_REGION = 8, 2, 2
SLOT_BUCKETS = 4096  # three hex digits


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, base: int = BASE_SHARDS) -> list[Leaf]:
    """A tree of ``shards`` equal shards.  The first ``base`` are two to a rack and two racks to a region;
    each later one stands in a region of its own."""
    out = []
    for s in range(shards):
        if s < base and shards >= base:
            rack = s // PER_RACK
            out.append(Leaf(f"g{rack // RACKS_PER_REGION}", f"r{rack}", s))
        else:
            out.append(Leaf(f"own{s}", f"own{s}", s))
    return out


def add_shard(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a subtree of its own."""
    s = 1 + max((x.shard for x in tree), default=-1)
    return [*tree, Leaf(f"own{s}", f"own{s}", s, weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + name))), 1, 13), 16, 10).cast("double")
    return F.log((bits + 0.5) / float(2**52)) / F.lit(float(weight))


def _pick(key: Column, children: dict[str, float]) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct(_draw(key, n, w).alias("d"), F.lit(n).alias("n")) for n, w in sorted(children.items())]
    return F.array_max(F.array(*draws))["n"]


def _weights(tree: list[Leaf], name) -> dict[str, float]:
    out: dict[str, float] = {}
    for x in tree:
        if x.weight > 0:
            out[name(x)] = out.get(name(x), 0.0) + x.weight
    return out


def place(df: DataFrame, key: Column, tree: list[Leaf], prefix: str = "") -> DataFrame:
    """Adds <prefix>region, <prefix>rack (strings) and <prefix>shard (int)."""
    region, rack, shard = f"{prefix}region", f"{prefix}rack", f"{prefix}shard"
    df = df.withColumn(region, _pick(key, _weights(tree, lambda x: "region " + x.region)))

    def within(column: str, level: str, name) -> Column:
        out = None
        for parent in sorted({f"{level} {getattr(x, level)}" for x in tree if x.weight > 0}):
            own = [x for x in tree if f"{level} {getattr(x, level)}" == parent]
            value = _pick(key, _weights(own, name))
            out = F.when(F.col(column) == parent, value) if out is None else out.when(F.col(column) == parent, value)
        return out

    df = df.withColumn(rack, within(region, "region", lambda x: "rack " + x.rack))
    df = df.withColumn(shard, within(rack, "rack", lambda x: f"shard {x.shard}"))
    return df.withColumn(shard, F.substring(shard, 7, 12).cast("int"))


def shards(docs: DataFrame, tree: list[Leaf], grown: list[Leaf]) -> DataFrame:
    """Needs doc_id and text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.substring(F.md5(F.concat(key, F.lit("|slot"))), 1, 3).alias("bucket"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    base = place(place(base, key, tree), key, grown, "grown_")
    base = job.written(base.select("doc_id", "size", "text_crc32", "bucket", "region", "rack", "shard", "grown_shard"), "shards")
    order = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = base.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    numbered = base.withColumn("k", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")))
    # At most SLOT_BUCKETS rows a shard.
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("k") - 1).cast("bigint").alias("slot"), "grown_shard", "region", "rack",
    )


def op1_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = topology(BASE_SHARDS)
    return shards(job.documents(spark, sf_dir), tree, add_shard(tree))


def _sql_pick(key: str, children: dict[str, float]) -> str:
    names = sorted(children)
    if len(names) == 1:
        return f"'{names[0]}'"
    draw = "ln((('0x' || substr(md5({k} || '|{n}'), 1, 13))::bigint + 0.5) / 4503599627370496.0) / {w}"
    draws = ", ".join("{'d': " + draw.format(k=key, n=n, w=float(children[n])) + f", 'n': '{n}'}}" for n in names)
    return f"list_max([{draws}]).n"


def _sql_tree(key: str, tree: list[Leaf], prefix: str) -> tuple[str, str, str]:
    def within(column: str, level: str, name) -> str:
        whens = []
        for parent in sorted({f"{level} {getattr(x, level)}" for x in tree}):
            own = [x for x in tree if f"{level} {getattr(x, level)}" == parent]
            whens.append(f"when {column} = '{parent}' then {_sql_pick(key, _weights(own, name))}")
        return "case " + " ".join(whens) + " end"

    return (
        _sql_pick(key, _weights(tree, lambda x: "region " + x.region)) + f" as {prefix}region",
        within(f"{prefix}region", "region", lambda x: "rack " + x.rack) + f" as {prefix}rack",
        within(f"{prefix}rack", "rack", lambda x: f"shard {x.shard}") + f" as {prefix}leaf",
    )


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def oracle() -> str:
    tree = topology(BASE_SHARDS)
    key = "coalesce(doc_id::varchar, '')"
    a, b = _sql_tree(key, tree, ""), _sql_tree(key, add_shard(tree), "grown_")
    table = "[" + ", ".join(f"{x}::bigint" for x in _crc_table()) + "]"
    crc = (
        "xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint), "
        f"lambda c, b: xor(c >> 8, ({table})[(xor(c, b) & 255) + 1]), 4294967295::bigint))"
    )
    return f"""
with t0 as (select doc_id, strlen(coalesce(text, ''))::bigint + 1 as size, {crc} as text_crc32,
    substr(md5({key} || '|slot'), 1, 3) as bucket, {a[0]}, {b[0]} from documents),
t1 as (select *, {a[1]}, {b[1]} from t0),
t2 as (select *, {a[2]}, {b[2]} from t1)
select doc_id, size, text_crc32::bigint as text_crc32, 'key' as law, substr(leaf, 7)::int as shard,
    row_number() over (partition by leaf order by bucket, doc_id nulls first, text_crc32, size) - 1 as slot,
    substr(grown_leaf, 7)::int as grown_shard, region, rack from t2
"""
