"""The corpus pipeline: documents through the stages of STAGES, each written as Parquet and read again.

Every stage keeps the columns of ``documents`` but the last, which returns packed pieces. Stages work on all that the one before kept.

Defined results, for every stage: columns beside those of ``documents`` are dropped, whatever their names; an empty table passes through as an empty one; texts are
worked on whole, however long. A null or letterless text has no language and goes in the first stage. Rows are told apart by all their columns, so a null or repeated id
neither shields a row nor costs it its place: of near duplicates the least id stays, a null one being the last, and ties go to the least row key; equal rows are one. Nulls in
``lang``, ``source`` and ``n_chars`` are kept; a null source is a source. Ties in mixing are ordered by the seeded hash, then row key and size; in packing by id, piece and checksum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import langid, mixing, neardup, packing, secrets
from factloom.llm.storage import Scratch, drop_path, materialize, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if no language is found, or the found one is hardly likelier than an even draw among the labels.
SURE = 1.2
#: Row keys that are broadcast at most: some 40 MB.
MOST_KEYS = 1_000_000
#: Rows of an Arrow batch in language ID.
BATCH_ROWS = 2000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language; fits on the stage's own labelled documents.

    The keys of what goes are found first, in small Arrow batches; whole rows then meet them without leaving the JVM.
    """
    with small_batches(spark, BATCH_ROWS):
        model = langid.fit(docs)
        if not model.labels:
            return docs.select(*COLUMNS)
        keyed = docs.withColumn("_row", row_key())
        sure = (F.col("lang_pred") != langid.NONE) & (F.col("score") >= min(0.5, SURE / len(model.labels)))
        gone = langid.predict(keyed.select("_row", "text"), model).filter(~F.coalesce(sure, F.lit(False)))
        gone = materialize(gone.select("_row").distinct(), "pipeline-unknown")
    return keyed.join(by_row(gone), "_row", "left_anti").select(*COLUMNS)


def by_row(found: DataFrame) -> DataFrame:
    """A written table of row keys, ready to be joined to whole rows: broadcast, so that no text moves, while its counted rows are within ``MOST_KEYS``, else merged."""
    return F.broadcast(found) if found.count() <= MOST_KEYS else found.hint("merge")


def row_key() -> Column:
    """A row's key: 64 bits of the hash of all its columns, so only equal rows share one; the flags tell nulls in different columns apart."""
    return F.xxhash64(*COLUMNS, F.concat(*[F.col(c).isNull().cast("string") for c in COLUMNS]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: the one with the least id (a null id is the last), then the least key.

    Rows are told apart by :func:`row_key`, so different texts of one id are compared like those of any two ids, and rows with a null id take part.
    """
    keyed = docs.withColumn("_row", row_key())
    found = neardup.near_duplicates(keyed, "_row").filter("n_shingles > 0")
    groups = materialize(found.groupBy(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).agg(F.count(F.lit(1)).alias("_rows")), "pipeline-groups")
    ids = keyed.select("_row", "doc_id").distinct()
    first = groups.join(ids, "_row").groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("_first")).select("_first._row")
    gone = groups.join(first, "_row", "left_anti").select("_row")
    # Of equal rows that are first in their group one stays.
    repeated = materialize(groups.filter("_rows > 1").join(first, "_row", "left_semi").select("_row"), "pipeline-repeated")
    if repeated.isEmpty():
        return keyed.join(by_row(materialize(gone, "pipeline-gone")), "_row", "left_anti").select(*COLUMNS)
    gone = materialize(gone.unionByName(repeated), "pipeline-gone")
    once = keyed.join(by_row(repeated), "_row", "left_semi").dropDuplicates(["_row"])
    return keyed.join(by_row(gone), "_row", "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; all documents stay."""
    clean = secrets.redact(secrets.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings sources to their target weights: rows are taken as often as the mix says, or not at all; equal rows are one that counts for all."""
    keyed = docs.withColumn("_row", row_key())
    sized = keyed.select("_row", "source", mixing.words(F.col("text")).alias("size"), F.array("source").alias("members"))
    plan = mixing.mix(materialize(sized, "pipeline-sizes"), "_row", "size", "members", mixing.contract_quotas)
    taken = materialize(plan.groupBy("_row").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).filter("_copies > 0"), "pipeline-taken")
    out = keyed.join(by_row(taken.filter("_rows = 1")), "_row")
    if not taken.filter("_rows > 1").isEmpty():
        out = out.unionByName(keyed.join(by_row(taken.filter("_rows > 1")), "_row").dropDuplicates(["_row"]))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("secret scans", secret_scan), ("mixing to target weights", mix), ("best-fit packing", pack)]
#: A trained classifier and a tokenizer have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs, before = stage(spark, docs, sf_dir), list(scratch.paths)
        if k + 1 < len(STAGES):
            docs = scratch.put(docs, f"pipeline-{k + 1}")
        # What a stage wrote is read by the next alone; packing has read its own by now.
        for path in before:
            drop_path(spark, path)
            scratch.paths.remove(path)
    return docs
