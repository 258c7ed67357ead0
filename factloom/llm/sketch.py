"""Document fingerprints: threshold-scaled sketches of word shingles. [native]

A sketch keeps every distinct shingle hash below a fixed fraction of the hash space. The rule is the same for every document, so the
sketch of a union is the union of sketches, and the share of one sketch found in another estimates containment without bias
however unequal the documents are. A text of at most ``SHORT`` shingles, of which the fraction would leave next to nothing, keeps its other hashes as well: two
such texts are compared exactly, and one of them with a longer text by the hashes below the bound, as any others. The hash is the leading 48 bits of a shingle's MD5 in hexadecimal, whose string order is its
numeric order; the fraction is thus one string comparison.

Shingles are five words (`[^\\x20\\x09-\\x0D]+`) joined by one space; a text of one to four words has one shingle of all its words.

Defined results: a null text counts as empty and has no shingles; texts of the same words in order are alike (1.0), two without words too; else two texts that have no
hash to compare are not alike (0.0); whole texts count, however long; repeated rows are neighbours of each other in :func:`next_texts`; rows of one id follow each
other by descending MD5 of their texts; a null id sorts after all others; the only document is its own neighbour; an empty table gives an empty result; other
columns are kept, whatever their names, but ``next_text`` and ``next_sketch`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.storage import fresh, materialize, partitions

SPACE = r"[\x20\x09-\x0D]+"
SHINGLE = 5
#: A hash is kept if it is below this hexadecimal bound: one quarter of all.
BOUND = "4"
DIGITS = 12
SHORT = 32
#: Bytes of text in a key range.
RANGE_BYTES = 32_000_000


def sketch(text: Column, width: int = SHINGLE, bound: str = BOUND, short: int = SHORT) -> Column:
    """Struct of ``n`` (words), ``whole`` (a digest of all words in order), ``hashes`` (sorted distinct retained hashes) and ``rest`` (the others of a short text)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")

    def made(w: Column) -> Column:
        every = F.transform(F.array(_digests(w, width)), lambda d: F.struct(
            F.array_sort(F.array_distinct(F.filter(d, lambda h: h < bound))).alias("hashes"),
            F.when(F.size(d) <= short, F.array_sort(F.array_distinct(F.filter(d, lambda h: h >= bound)))).otherwise(_none()).alias("rest"), F.size(d).alias("shingles")))[0]
        return F.struct(F.size(w).alias("n"), F.substring(F.md5(F.array_join(w, " ")), 1, DIGITS).alias("whole"), every.alias("of"))

    s = F.transform(F.array(words), made)[0]
    return F.transform(F.array(s), lambda x: F.struct(x["n"].alias("n"), x["whole"].alias("whole"), x["of"]["hashes"].alias("hashes"), x["of"]["rest"].alias("rest"), (x["of"]["shingles"] <= short).alias("exact")))[0]


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def _digests(words: Column, width: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))
    digests = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(words, i, width), " ")), 1, DIGITS))
    return F.when(F.size(words) > 0, digests).otherwise(_none())


def merge(a: Column, b: Column) -> Column:
    """The hashes of the sketch of both texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; null if ``a`` has no hash."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger, 0 to 1; ``a`` and ``b`` are structs of :func:`sketch`."""
    share = lambda x, y: F.transform(F.array(F.least(F.size(x), F.size(y))), lambda n: F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(0.0))[0]
    every = lambda s: F.concat(s["hashes"], s["rest"])  # noqa: E731 - in hash order, as the rest lies above the bound
    near = F.when(a["exact"] & b["exact"], share(every(a), every(b))).otherwise(share(a["hashes"], b["hashes"]))
    return F.when((a["n"] == b["n"]) & (a["whole"] == b["whole"]), 1.0).otherwise(near).cast("double")


def render(s: Column) -> Column:
    """A sketch as text: its hashes, or the digest of all words where there is none."""
    hashes = F.array_join(F.concat(s["hashes"], s["rest"]), ",")
    return F.when((hashes == "") & (s["n"] > 0), F.concat(F.lit("="), s["whole"])).otherwise(hashes)


def next_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Adds ``next_text`` and ``next_sketch``: of the row that follows by descending ``key``, then descending MD5 of the text; after the last, of the first.

    Rows are dealt into key ranges, so no task sees the whole order. Percentiles of the key are the coarse bounds (a key that is a percentile several times is hot, and its
    rows are dealt further by the MD5); each coarse range is cut evenly into as many as its bytes ask for, so ranges grow in number with the corpus, not in size. Only each
    range's first row is looked up from the range before it.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()["bytes"]
    coarse = max(1, min(1000, 8 * partitions(spark)))  # several for each partition, so that hashing deals them evenly
    fine = max(1, -(-size // (coarse * range_bytes)))
    points = [i / coarse for i in range(1, coarse)]
    found = docs.agg(F.percentile_approx(key, points, 10_000).alias("b")).first()["b"] or [] if points else []
    bounds = sorted(set(found))
    part, digest, own, lead = fresh(docs, "part", "digest", "own", "lead")
    t = F.coalesce(F.col(text), F.lit(""))
    at = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b < F.col(key))) if bounds else F.lit(0)
    # Within a coarse range: the place between its bounds, or for a hot key, which is a bound itself, the place of the MD5.
    ends = F.lit([(bounds or [0])[0] - 1, *bounds, (bounds or [0])[-1] + 1]).cast("array<bigint>")
    low, high = F.get(ends, at), F.get(ends, at + 1)
    inner = F.floor((F.col(key) - low - 1) * fine / F.greatest(high - low, F.lit(1)))
    hot = sorted(b for b in bounds if found.count(b) > 1)
    times = {b: fine * found.count(b) for b in hot}
    spread = F.floor(F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") * F.try_element_at(F.create_map(*[F.lit(x) for kv in times.items() for x in kv]), F.col(key)) / F.lit(1 << 24)) if hot else F.lit(0)
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    no_key = F.floor(F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") * (coarse * fine) / F.lit(1 << 24))
    # One number for (coarse range, place in it, place of a hot key's row); rows without a key come below all.
    cut = F.least(F.greatest(F.when(is_hot, F.lit(fine)).otherwise(inner), F.lit(0)), F.lit(fine))
    place = F.when(F.col(key).isNull(), no_key).otherwise(((at.cast("long") + 1) * (fine + 1) + cut) * (coarse * fine + 1) + F.when(is_hot, spread).otherwise(0)).cast("long")
    ranged = docs.withColumn(digest, F.md5(t)).withColumn(part, place)
    order = [F.desc_nulls_last(key), F.desc(digest)]
    top = ranged.groupBy(part).agg(F.max_by(t, F.struct(F.col(key).isNotNull(), key, digest)).alias("_head"))  # one row for each range, partial maxima first
    heads = materialize(top.select(part, "_head", sketch(F.col("_head")).alias("_sketch")), "sketch-heads")
    # The range that follows by descending key is the next lower one that has rows; after the lowest comes the highest. Only names of ranges meet here.
    names = heads.select(part, F.lead(part).over(Window.orderBy(F.desc(part))).alias("_to"), F.max(part).over(Window.partitionBy()).alias("_first"))
    follow = names.select(F.col(part), F.coalesce("_to", "_first").alias("_to")).join(heads.withColumnsRenamed({part: "_to"}), "_to").drop("_to")
    within = Window.partitionBy(part).orderBy(*order)
    both = F.struct(t.alias("text"), F.col(own).alias("sketch"))
    led = ranged.repartition(part).withColumn(own, sketch(t)).withColumn(lead, F.lead(both).over(within)).join(follow, part)
    out = led.withColumns({"next_text": F.coalesce(F.col(f"{lead}.text"), F.col("_head")), "next_sketch": F.coalesce(F.col(f"{lead}.sketch"), F.col("_sketch"))})
    return out.withColumn("sketch", F.col(own)).drop(part, digest, own, lead, "_head", "_sketch")


def op6_scaled_sketch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, its edited form, and their likeness to each other and to the next document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    df = next_texts(docs).withColumn("edited", edited).withColumn("other", sketch(F.col("edited")))
    return df.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), render(F.col("sketch")).alias("fingerprint"), render(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("other")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, md5(text) DESC)) AS nxt
  FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, md5(text) DESC)
),
e AS (SELECT doc_id, text, nxt, substr(text, 1, length(text) - length(text) // 2) || substr(nxt, 1, length(text) // 2) AS edited FROM n),
w AS (
  SELECT doc_id, text, edited,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS wt,
    list_filter(regexp_split_to_array(edited, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS we,
    list_filter(regexp_split_to_array(nxt, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS wn
  FROM e
),
s AS (
  SELECT doc_id, text, edited, wt, we, wn,
    list_transform(range(1, greatest(len(wt) - 4, CASE WHEN len(wt) > 0 THEN 1 ELSE 0 END) + 1), lambda i: substr(md5(array_to_string(wt[i:i+4], ' ')), 1, 12)) AS st,
    list_transform(range(1, greatest(len(we) - 4, CASE WHEN len(we) > 0 THEN 1 ELSE 0 END) + 1), lambda i: substr(md5(array_to_string(we[i:i+4], ' ')), 1, 12)) AS se,
    list_transform(range(1, greatest(len(wn) - 4, CASE WHEN len(wn) > 0 THEN 1 ELSE 0 END) + 1), lambda i: substr(md5(array_to_string(wn[i:i+4], ' ')), 1, 12)) AS sn
  FROM w
),
k AS (
  SELECT *, list_sort(list_distinct(list_filter(st, lambda h: len(st) <= 32 OR h < '4'))) AS ft, list_sort(list_distinct(list_filter(se, lambda h: len(se) <= 32 OR h < '4'))) AS fe,
    list_sort(list_distinct(list_filter(st, lambda h: (len(st) <= 32 AND len(se) <= 32) OR h < '4'))) AS ate, list_sort(list_distinct(list_filter(se, lambda h: (len(st) <= 32 AND len(se) <= 32) OR h < '4'))) AS aet,
    list_sort(list_distinct(list_filter(st, lambda h: (len(st) <= 32 AND len(sn) <= 32) OR h < '4'))) AS atn, list_sort(list_distinct(list_filter(sn, lambda h: (len(st) <= 32 AND len(sn) <= 32) OR h < '4'))) AS ant
  FROM s
)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
  CASE WHEN len(ft) = 0 AND len(wt) > 0 THEN '=' || substr(md5(array_to_string(wt, ' ')), 1, 12) ELSE array_to_string(ft, ',') END AS fingerprint,
  CASE WHEN len(fe) = 0 AND len(we) > 0 THEN '=' || substr(md5(array_to_string(we, ' ')), 1, 12) ELSE array_to_string(fe, ',') END AS edited_fingerprint,
  CAST(CASE WHEN wt = we THEN 1 WHEN least(len(ate), len(aet)) > 0 THEN len(list_intersect(ate, aet)) / least(len(ate), len(aet)) ELSE 0 END AS DOUBLE) AS near_edited,
  CAST(CASE WHEN wt = wn THEN 1 WHEN least(len(atn), len(ant)) > 0 THEN len(list_intersect(atn, ant)) / least(len(atn), len(ant)) ELSE 0 END AS DOUBLE) AS near_next
FROM k
"""
