"""URL filtering by dated lists.

A list is a table of dated entries: (domain, at, action), where ``block`` puts a domain and all its
subdomains on the list from that time on and ``allow`` takes it off again.  An entry holds until the
domain's next one: dated entries become validity intervals [from, to).  Every capture (url, fetch
time) is evaluated against the entries of its host and of the host's parent domains that were
active when it was fetched, by an as-of join; the entry of the longest domain decides, of equal
domains and times ``block`` before ``allow``, and a host without an active entry is allowed.

Captures are first reduced to distinct (host, time) pairs, and these to (domain, host, time) for those of the host's
domains that the list holds, whatever the number of labels.  Pairs and entries then stand in one order of time for each domain,
and the last entry at or before a pair is the active one: no pair meets more than one entry of a domain.  A domain of over
``HOT`` pairs is cut into as many salted parts as keep each below that, the domain's entries being repeated for each part only.

A host has no final dot; a url may lack the scheme (//host/path).
Null urls and urls without a host are allowed with a null host; null times match no entry.  List rows with
null domain or time are ignored; repeated rows count once.  Repeated captures are kept.  Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import job

HOT = 100_000
HOST = "^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, from_ts, to_ts, action) from dated entries; to_ts is null for the last one."""
    at = entries.where("domain is not null and at is not null and action in ('allow', 'block')")
    one = at.select(F.rtrim(F.lower("domain"), F.lit(".")).alias("domain"), F.col("at").alias("from_ts"), "action").groupBy("domain", "from_ts").agg(F.max("action").alias("action"))
    order = Window.partitionBy("domain").orderBy("from_ts")
    return one.withColumn("to_ts", F.lead("from_ts").over(order)).select("domain", "from_ts", "to_ts", "action")


def _domains(host: Column) -> Column:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def decide(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: page_id, url, fetched_at; entries: domain, at, action.  Returns page_id, url, host,
    fetched_at, the deciding domain and since when it holds (null if none), and blocked."""
    captures = captures.select("page_id", "url", "fetched_at", host_of(F.col("url")).alias("host"))
    may = F.col("host").isNotNull() & F.col("fetched_at").isNotNull()
    asked = captures.where(may).select("host", "fetched_at").distinct()
    listed = job.written(intervals(entries), "url-intervals")
    domains = job.written(listed.select("domain").distinct(), "url-domains")
    known = asked.select("host", "fetched_at", F.explode(_domains(F.col("host"))).alias("domain"))
    known = job.written(known.join(job.maybe_broadcast(domains), "domain", "left_semi"), "url-known")
    parts = known.groupBy("domain").count().where(F.col("count") > HOT).select("domain", F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
    parts = job.maybe_broadcast(job.written(parts, "url-hot"))
    n = F.coalesce("parts", F.lit(1))
    pairs = known.join(parts, "domain", "left").select(
        "domain", F.pmod(F.xxhash64("host", "fetched_at"), n).cast("int").alias("salt"), F.col("fetched_at").alias("at"), F.lit(1).alias("asks"), "host",
        F.lit(None).cast("struct<from_ts:timestamp,to_ts:timestamp,action:string>").alias("entry"),
    )
    dated = listed.join(parts, "domain", "left").select(
        "domain", F.explode(F.sequence(F.lit(0), n - 1)).alias("salt"), F.col("from_ts").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("string").alias("host"),
        F.struct("from_ts", "to_ts", "action").alias("entry"),
    )
    order = Window.partitionBy("domain", "salt").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = pairs.unionByName(dated).withColumn("e", F.last("entry", ignorenulls=True).over(order)).where("asks = 1 and e is not null")
    joined = joined.select("host", F.col("at").alias("fetched_at"), "domain", "e.from_ts", "e.to_ts", "e.action")
    active = joined.where(F.col("to_ts").isNull() | (F.col("fetched_at") < F.col("to_ts")))
    best = active.groupBy("host", "fetched_at").agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "from_ts", "action")).alias("b"))
    best = best.select("host", "fetched_at", F.col("b.domain").alias("domain"), F.col("b.from_ts").alias("since"), F.col("b.action").alias("action"))
    best = job.maybe_broadcast(job.written(best, "url-decided"))
    # Captures without a host or time would meet in one task of the join.
    nothing = [F.lit(None).cast("string").alias("domain"), F.lit(None).cast("timestamp").alias("since"), F.lit(None).cast("string").alias("action")]
    out = captures.where(may).join(best, ["host", "fetched_at"], "left").unionByName(captures.where(~may).select("*", *nothing))
    return out.select("page_id", "url", "host", "fetched_at", "domain", "since", (F.coalesce("action", F.lit("allow")) == "block").alias("blocked"))


# The tables hold neither fetch times nor lists; the query derives both from the pages, as its SQL does.

def captures_of(pages: DataFrame) -> DataFrame:
    """Page n was fetched n mod 720 hours after the start of 2024."""
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(pmod(page_id, 720) as int))")
    return pages.select("page_id", "url", at.alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Each host is listed by itself or by its last two labels, as its md5 says, for one or two spans."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    digit = lambda k: F.conv(F.substring(F.md5("host"), k, 2), 16, 10).cast("int")
    hosts = hosts.select("host", digit(1).alias("a"), digit(3).alias("b"), digit(5).alias("c"))
    parent = F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")
    domain = F.when((F.col("a") % 5 == 4) & (F.size(F.split("host", r"\.")) > 2), parent).otherwise(F.col("host"))
    hosts = hosts.where("a % 5 > 1").select(domain.alias("domain"), "a", "b", "c")
    dates = F.array(
        F.struct(F.col("b").alias("h"), F.lit("block").alias("action")),
        F.struct((F.col("b") + F.col("c")).alias("h"), F.lit("allow").alias("action")),
        F.struct((F.col("b") + 2 * F.col("c") + 60).alias("h"), F.when(F.col("a") % 2 == 0, "block").otherwise("allow").alias("action")),
    )
    flat = hosts.select("domain", F.explode(dates).alias("x"))
    return flat.select("domain", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, x.h)").alias("at"), F.col("x.action").alias("action"))


def op2_dated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = decide(captures_of(pages), entries_of(pages))
    return out.select("page_id", "url", "host", _text("fetched_at"), "domain", _text("since"), "blocked")


def _text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


ORACLE = r"""
with cap as (select page_id, url, nullif(rtrim(lower(regexp_extract(url, '^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') as host,
        timestamp '2024-01-01 00:00:00' + to_hours((page_id % 720)::int) as fetched_at from pages),
hosts as (select distinct host, ('0x' || substr(md5(host), 1, 2))::int as a, ('0x' || substr(md5(host), 3, 2))::int as b,
        ('0x' || substr(md5(host), 5, 2))::int as c from cap where host is not null),
dom as (select case when a % 5 = 4 and len(string_split(host, '.')) > 2 then array_to_string(string_split(host, '.')[-2:], '.') else host end as domain, a, b, c
        from hosts where a % 5 > 1),
dated as (select domain, b as h, 'block' as action from dom union all select domain, b + c, 'allow' from dom
        union all select domain, b + 2 * c + 60, case when a % 2 = 0 then 'block' else 'allow' end from dom),
one as (select domain, timestamp '2024-01-01 00:00:00' + to_hours(h) as from_ts, max(action) as action from dated group by all),
span as (select *, lead(from_ts) over (partition by domain order by from_ts) as to_ts from one),
best as (select page_id, arg_max(domain, length(domain)) as domain, arg_max(from_ts, length(domain)) as since, arg_max(action, length(domain)) as action
        from cap join span on (host = domain or ends_with(host, '.' || domain)) and fetched_at >= from_ts and (to_ts is null or fetched_at < to_ts) group by page_id)
select cap.page_id, url, host, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') as fetched_at, domain, strftime(since, '%Y-%m-%d %H:%M:%S') as since,
    coalesce(action, 'allow') = 'block' as blocked from cap left join best using (page_id)
"""
