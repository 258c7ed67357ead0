"""URL filters whose lists change over time: a temporal list join. [native]

A list is a log of dated entries: at ``at`` a pattern begins to say ``block`` or ``allow``, or is taken off (``remove``). Each entry holds until
the next one for its pattern, which makes validity intervals. A capture is judged by the entries active at its fetch time: an
as-of join on (pattern, time bucket) with the interval as condition. Patterns are ``host:<suffix>`` (the host or any subdomain) and
``path:<host><prefix>`` (a path prefix that ends at a slash or is the whole path). Of the active entries the longest pattern decides;
between equally long ones ``block`` wins.

Intervals are cut at bucket bounds inside the span of the captures. A popular host is thus spread over the buckets of time, and a pattern
with a long history joins only the entries of the bucket. A pattern that covers a large share of a bucket's captures, as a top-level domain does, is salted: its captures are
dealt over as many parts as they need, and each part gets the bucket's few intervals.

Defined results: a null or malformed URL, or a null fetch time, matches nothing and is kept; URLs may be of any length; entries with a null pattern, action or
time are ignored; of several entries for one pattern at one instant the alphabetically first action holds; repeated captures (same id, URL and
time) give one row; empty lists keep everything and no captures give no rows; other columns of captures and entries are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.storage import materialize

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]+)?([^?#]*)"
BUCKET_DAYS = 32
#: Captures of one pattern in one bucket that go to one part, and the most salted cells for each pattern of an average capture.
PART_ROWS = 2_000
MOST_CELLS = 10_000
FOREVER = "9999-01-01 00:00:00"


def patterns_of(url: Column) -> Column:
    """Every pattern that covers the URL."""
    parts = F.struct(F.lower(F.regexp_extract(url, URL, 1)).alias("host"), F.split(F.lower(F.regexp_extract(url, URL, 1)), r"\.").alias("labels"), F.split(F.regexp_extract(url, URL, 2), "/").alias("steps"))

    def every(p: Column) -> Column:
        host, labels, steps = p["host"], p["labels"], p["steps"]
        hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
        folders = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("path:"), host, F.array_join(F.slice(steps, 1, i), "/"), F.when(i < F.size(steps), "/").otherwise("")))
        return F.when(host != "", F.array_distinct(F.concat(hosts, folders))).otherwise(F.expr("cast(array() as array<string>)"))

    # The parts are bound once; a lambda would else take the URL apart again for each pattern.
    return F.coalesce(F.transform(F.array(parts), every)[0], F.expr("cast(array() as array<string>)"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) from the log (pattern, action, at); the end is exclusive."""
    log = entries.filter("pattern is not null and action is not null and at is not null").groupBy("pattern", "at").agg(F.min("action").alias("action"))
    until = F.lead("at").over(Window.partitionBy("pattern").orderBy("at"))
    return log.withColumn("valid_to", F.coalesce(until, F.lit(FOREVER).cast("timestamp_ntz"))).withColumnRenamed("at", "valid_from").filter("action <> 'remove'")


def judge(captures: DataFrame, entries: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(capture_id, url, fetched_at, decision, pattern, n_active) for captures (capture_id, url, fetched_at)."""
    days = lambda c: F.unix_date(F.to_date(c))
    captures, entries = captures.select("capture_id", "url", "fetched_at"), entries.select("pattern", "action", "at")
    span = captures.agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b"), F.count(F.lit(1)).alias("n")).first()
    begin, end = (F.lit(x).cast("timestamp_ntz") for x in (span["a"], span["b"]))
    valid = intervals(entries).filter((F.col("valid_from") <= end) & (F.col("valid_to") > begin))
    low, high = days(F.greatest("valid_from", begin)), days(F.least("valid_to", end))
    valid = valid.withColumn("bucket", F.explode(F.sequence(F.floor(low / BUCKET_DAYS), F.floor(high / BUCKET_DAYS))))
    keyed = captures.select("capture_id", "url", "fetched_at").withColumn("pattern", F.explode_outer(patterns_of(F.col("url")))).withColumn("bucket", F.floor(days(F.col("fetched_at")) / BUCKET_DAYS))
    # Cells with many captures, counted with partial sums; a cell has rows / MOST_CELLS captures at least, so there are MOST_CELLS times the patterns of a capture at most.
    most = max(part_rows, span["n"] // MOST_CELLS)
    hot = keyed.filter("pattern is not null").groupBy("pattern", "bucket").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).filter("parts > 1")
    hot = F.broadcast(materialize(hot, "url-hot"))
    own = F.pmod(F.xxhash64("capture_id", "url", "fetched_at"), F.coalesce("parts", F.lit(1))).cast("int")
    keyed = keyed.join(hot, ["pattern", "bucket"], "left").withColumn("part", own).drop("parts")
    valid = valid.join(hot, ["pattern", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    c, v = keyed.alias("c"), valid.alias("v")
    on = (F.col("c.pattern") == F.col("v.pattern")) & (F.col("c.bucket") == F.col("v.bucket")) & (F.col("c.part") == F.col("v.part")) & (F.col("c.fetched_at") >= F.col("v.valid_from")) & (F.col("c.fetched_at") < F.col("v.valid_to"))
    hit = c.join(v, on, "left").select("c.capture_id", "c.url", "c.fetched_at", F.col("v.pattern").alias("pattern"), F.col("v.action").alias("action"))
    rank = F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), F.col("action").alias("action"), F.col("pattern").alias("pattern")))
    best = hit.groupBy("capture_id", "url", "fetched_at").agg(F.max(rank).alias("best"), F.size(F.collect_set("pattern")).cast("long").alias("n_active"))
    decision = F.when(F.col("best.action") == "block", "block").otherwise("keep")
    return best.select("capture_id", "url", "fetched_at", decision.alias("decision"), F.col("best.pattern").alias("pattern"), "n_active")


def _draw(text: Column, first: int) -> Column:
    """A number below 2**16 from four hexadecimal digits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), first, 4), 16, 10).cast("int")


def list_log(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, site folders and domains that the pages name; all dates follow from the patterns' MD5."""
    every = pages.select(F.explode(patterns_of(F.col("url"))).alias("pattern")).distinct()
    some = every.filter(_draw(F.col("pattern"), 1) % 4 < 3)
    start = F.lit("2023-07-01 00:00:00").cast("timestamp_ntz")
    day = lambda n: start + F.make_dt_interval(n)
    first, gap = _draw(F.col("pattern"), 5) % 400, _draw(F.col("pattern"), 9) % 120 + 1
    kind = _draw(F.col("pattern"), 13) % 3
    events = F.array(
        F.struct(F.when(kind == 2, "allow").otherwise("block").alias("action"), day(first).alias("at")),
        F.struct(F.lit("remove").alias("action"), day(first + gap).alias("at")),
        F.struct(F.when(kind == 1, "allow").otherwise("block").alias("action"), day(first + gap * 2).alias("at")),
    )
    return some.select("pattern", F.explode(events).alias("e")).select("pattern", "e.action", "e.at")


def op5_temporal_url_filter(spark, sf_dir: str) -> DataFrame:
    """Judges every page by the entries active when it was fetched."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("page_id") * 7919 % 8760).cast("int"))
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched_at"))
    return judge(captures, list_log(pages)).withColumnRenamed("capture_id", "page_id")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_hours(CAST(page_id * 7919 % 8760 AS INTEGER)) AS fetched_at,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]+)?([^?#]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]+)?([^?#]*)', 2) AS path
  FROM pages
),
l AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS steps FROM p WHERE host <> ''),
k AS (
  SELECT DISTINCT page_id, url, fetched_at, unnest(list_concat(
    list_transform(range(1, len(labels) + 1), lambda i: 'host:' || array_to_string(labels[i:], '.')),
    list_transform(range(1, len(steps) + 1), lambda i: 'path:' || host || array_to_string(steps[1:i], '/') || CASE WHEN i < len(steps) THEN '/' ELSE '' END)
  )) AS pattern
  FROM l
),
d AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 4) AS INTEGER) % 4 AS u, CAST('0x' || substr(md5(pattern), 5, 4) AS INTEGER) % 400 AS f,
    CAST('0x' || substr(md5(pattern), 9, 4) AS INTEGER) % 120 + 1 AS g, CAST('0x' || substr(md5(pattern), 13, 4) AS INTEGER) % 3 AS kind
  FROM (SELECT DISTINCT pattern FROM k)
),
e AS (
  SELECT pattern, CASE WHEN kind = 2 THEN 'allow' ELSE 'block' END AS action, TIMESTAMP '2023-07-01' + to_days(f) AS at FROM d WHERE u < 3
  UNION ALL SELECT pattern, 'remove', TIMESTAMP '2023-07-01' + to_days(f + g) FROM d WHERE u < 3
  UNION ALL SELECT pattern, CASE WHEN kind = 1 THEN 'allow' ELSE 'block' END, TIMESTAMP '2023-07-01' + to_days(f + g * 2) FROM d WHERE u < 3
),
a AS (SELECT k.page_id, k.url, k.fetched_at, e.pattern, e.action FROM k ASOF JOIN e ON k.pattern = e.pattern AND k.fetched_at >= e.at),
r AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, url, fetched_at ORDER BY length(pattern) DESC, action DESC, pattern DESC) AS n,
    count(*) OVER (PARTITION BY page_id, url, fetched_at) AS n_active
  FROM a WHERE action <> 'remove'
)
SELECT p.page_id, p.url, p.fetched_at, CASE WHEN r.action = 'block' THEN 'block' ELSE 'keep' END AS decision, r.pattern, coalesce(r.n_active, 0) AS n_active
FROM (SELECT DISTINCT page_id, url, fetched_at FROM p) p
LEFT JOIN r ON r.n = 1 AND p.page_id IS NOT DISTINCT FROM r.page_id AND p.url = r.url AND p.fetched_at = r.fetched_at
"""
