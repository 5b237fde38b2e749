"""The hash tree: SQL on the tables, movement under changed weights, edges."""

import collections
import zlib

from vellum.llm import sharding
from tests.llm.oracle import same_rows

SF = "/root/testdata/sf0.001"


def test_same_as_sql(spark):
    same_rows(sharding.op1_hash_tree(spark, SF), sharding.oracle(), SF)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, size string")


def shard_of(spark, n, tree):
    from pyspark.sql import functions as F

    df = sharding.place(spark.range(n), F.col("id").cast("string"), tree)
    return {r.id: (r.region, r.rack, r.shard) for r in df.collect()}


def test_a_changed_weight_moves_rows_only_with_its_subtrees(spark):
    tree = sharding.topology(8)
    before = shard_of(spark, 4000, tree)
    sizes = collections.Counter(x[2] for x in before.values())
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.3 * min(sizes.values())
    after = shard_of(spark, 4000, sharding.add_shard(tree))
    moved = [k for k in before if before[k] != after[k]]
    assert all(after[k][2] == 8 for k in moved) and 300 < len(moved) < 600
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]
    later = shard_of(spark, 4000, heavier)
    # Shard 5 stands in rack 2 of region 1: rows of region 1 stay there, those of rack 2 in rack 2.
    for k in before:
        if before[k][0] == "region g1":
            assert later[k][0] == "region g1"
            if before[k][1] == "rack r2":
                assert later[k][1] == "rack r2"
        elif later[k][0] == "region g0":
            assert later[k] == before[k]
    drained = [sharding.Leaf(x.region, x.rack, x.shard, 0.0 if x.shard == 3 else 1.0) for x in tree]
    assert 3 not in {x[2] for x in shard_of(spark, 2000, drained).values()}


def test_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "é"), (None, "é"), (7, "x" * 500_000), (8, "x")]
    out = sharding.shards(frame(spark, rows), sharding.topology(8), sharding.topology(9)).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    got = {(r.doc_id, r.size, r.text_crc32) for r in out}
    assert (1, 1, 0) in got and (None, 3, zlib.crc32("é".encode())) in got and (7, 500_001, zlib.crc32(b"x" * 500_000)) in got
    assert sharding.shards(frame(spark, []), sharding.topology(8), sharding.topology(9)).count() == 0
