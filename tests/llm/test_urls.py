"""Dated lists: SQL on the tables, a plain loop over all entries, both join ways, edges."""

import datetime
import random

import pytest

from vellum.llm import job, urls
from tests.llm.oracle import same_rows

SF = "/root/testdata/sf0.001"
DAY = datetime.datetime(2024, 1, 1)


def test_same_as_sql(spark):
    same_rows(urls.op2_dated_lists(spark, SF), urls.ORACLE, SF)


def plain(url, at, entries):
    host = (url or "").split("://", 1)[-1].split("/")[0].lower() if url and "://" in url else None
    if not host or at is None:
        return False
    labels = host.split(".")
    for n in range(len(labels), 0, -1):
        own = [(t, a) for d, t, a in entries if d == ".".join(labels[-n:]) and t <= at]
        if own:
            return max(own)[1] == "block"
    return False


@pytest.mark.parametrize("limit", [job.BROADCAST_BYTES, -1])
def test_against_a_loop(spark, monkeypatch, limit):
    monkeypatch.setattr(job, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(urls, "HOT", 10)
    rng = random.Random(2)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.org", "y.x.org", "Z.net"]
    entries = [(rng.choice(hosts).lower(), DAY + datetime.timedelta(hours=rng.randint(0, 50)), rng.choice(["block", "allow"])) for _ in range(40)]
    caps = [(i, f"https://{rng.choice(hosts)}/p{i}", DAY + datetime.timedelta(hours=rng.randint(0, 60))) for i in range(300)]
    caps += [(900, None, DAY), (901, "no host", DAY), (902, "http://a.com/", None), (903, "", DAY), (0, "http://a.com", DAY), (0, "http://a.com", DAY)]
    df = spark.createDataFrame(caps, "page_id bigint, url string, fetched_at timestamp").selectExpr("*", "'clash' as domain", "1 as host")
    more = entries + [(None, DAY, "block"), ("a.com", None, "block"), entries[0]]
    lists = spark.createDataFrame(more, "domain string, at timestamp, action string")
    got = sorted((r.page_id, str(r.url), str(r.fetched_at), r.blocked) for r in urls.decide(df, lists).collect())
    assert got == sorted((i, str(u), str(t), plain(u, t, entries)) for i, u, t in caps)
    assert urls.decide(df.limit(0), lists).count() == 0
    assert not any(r.blocked for r in urls.decide(df, lists.limit(0)).collect())


def test_forms_of_urls(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.com./x", "//a.com/x", "HTTPS://u@B.A.com.:80/", "a.com/x", "///x", "http://."])], "page_id bigint, url string")
    df = df.selectExpr("*", "timestamp'2024-01-02' as fetched_at")
    entries = spark.createDataFrame([("A.com.", DAY, "block")], "domain string, at timestamp, action string")
    got = {r.page_id: (r.host, r.blocked) for r in urls.decide(df, entries).collect()}
    assert got == {0: ("a.com", True), 1: ("a.com", True), 2: ("b.a.com", True), 3: (None, False), 4: (None, False), 5: (None, False)}


@pytest.mark.parametrize("limit", [job.BROADCAST_BYTES, -1])
def test_deep_hosts(spark, monkeypatch, limit):
    monkeypatch.setattr(job, "BROADCAST_BYTES", limit)
    deep = ".".join("l%d" % i for i in range(40)) + ".a.com"
    parents = [deep.split(".", k)[-1] for k in (0, 5, 33, 34, 35, 40)]
    entries = [(d, DAY + datetime.timedelta(hours=k), "block" if k % 2 else "allow") for k, d in enumerate(reversed(parents))]
    caps = [(i, f"https://{h}/p", DAY + datetime.timedelta(hours=i % 8)) for i, h in enumerate(h for h in [*parents, "x." + deep, "xl9." + parents[2]] for _ in range(8))]
    df = spark.createDataFrame(caps, "page_id bigint, url string, fetched_at timestamp")
    got = {r.page_id: r.blocked for r in urls.decide(df, spark.createDataFrame(entries, "domain string, at timestamp, action string")).collect()}
    assert got == {i: plain(u, t, entries) for i, u, t in caps} and len(set(got.values())) == 2
