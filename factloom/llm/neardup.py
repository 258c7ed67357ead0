"""MinHash near-duplicates by min-max hashing: signatures, bands, links confirmed on full shingle sets, components.

Every permutation gives a document two values, its least and its greatest shingle hash, so a signature costs half the hash evaluations of
plain MinHash; each value agrees between two documents with the probability of their Jaccard similarity. Bands of consecutive values
are keys; documents that share a key are candidates.

Equal shingle sets are one class from the start, so thousands of copies are one row. What follows compares classes and is exact on candidates:

1. A class that has too many shingles of its own (found in no other candidate class) cannot be linked with anything and leaves. This
   takes out documents that merely share a passage or a line.
2. Each key's pivot, the member with the fewest shingles of its own, is compared with the others on full sets: first each class meets the
   pivot that it shares most keys with, then all pivots of its keys.
3. Keys that still hold several components: every member is described by its difference to the pivot (what it lacks, as a bit set, and what it adds).
   From two descriptions follows an upper bound of the similarity, which decides all pairs but those near the threshold inside a join's
   condition; only the rest is compared on full sets. Pairs inside a component are never compared: a link between them could
   not change anything.

So no link between components is lost, and a group of near copies is not expanded into its pairs.

Defined results: a null text counts as empty; a document without words is linked with nothing; whole texts count, however long; repeated rows are in one component and
keep their rows; a null id takes no part (null component, kept); an empty table gives an empty result; other columns are not returned, whatever their names. The result is a
written table; what led to it is deleted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import words
from factloom.llm.storage import Scratch, materialize, small_batches

MISS = 1e-7
BATCH_BYTES = 4_000_000
BATCH_ROWS = 2000
#: Ids that are broadcast at most: some 40 MB.
MOST_REPS = 1_000_000


def banding(threshold: float) -> tuple[int, int]:
    """(values in a band, bands): a pair at the threshold is missed with a probability below ``MISS``."""
    rows = 6 if threshold >= 0.85 else 5 if threshold >= 0.75 else 4
    return rows, math.ceil(math.log(MISS) / math.log(1 - threshold**rows))


def _parts(batches, sizes_of: int, most: int = BATCH_BYTES):
    """Slices of batches of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(sizes_of)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size + 64) // most
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(size)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    counts, codes, known = words.split(texts)
    n, h = words.shingles(counts, words.hashes(known)[codes] if len(codes) else np.zeros(0, np.uint64), width)
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])] if len(n) else []


def _class_of(s: np.ndarray) -> int:
    """A set's class: 64 bits of the hash of all its members, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _signer(width: int, rows: int, bands: int):
    values = rows * bands
    seeds = words.mix(np.arange(1, (values + 1) // 2 + 1, dtype=np.uint64)) | np.uint64(1)

    def band_keys(sets: list[np.ndarray]) -> np.ndarray:
        flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
        table = np.empty((len(sets), values + values % 2), np.uint64)
        x, shifted = np.empty_like(flat), np.empty_like(flat)  # one pair of buffers for all permutations
        with np.errstate(over="ignore"):
            for k, a in enumerate(seeds):
                np.multiply(flat, a, out=x)
                np.right_shift(x, np.uint64(29), out=shifted)
                np.bitwise_xor(x, shifted, out=x)
                np.multiply(x, np.uint64(0xBF58476D1CE4E5B9), out=x)
                table[:, 2 * k] = np.minimum.reduceat(x, at)
                table[:, 2 * k + 1] = np.maximum.reduceat(x, at)
            table = table[:, :values].reshape(len(sets), bands, rows)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands)).copy()
            for r in range(rows):
                key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + table[:, :, r])
        return key.astype(np.int64)

    def run(batches):
        for part in _parts(batches, 1):
            sets = _sets(part.column(1), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                for i, k in zip(full, band_keys([sets[i] for i in full]), strict=True):
                    keys[i] = k
            cls = [_class_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, sets), pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "cls", "bands"])
        words.trim()

    return run


def signatures(docs: DataFrame, key: str, text: str, width: int, threshold: float) -> DataFrame:
    """(doc_id, n, cls, bands); class and bands are null for documents without words."""
    rows, bands = banding(threshold)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_signer(width, rows, bands), "doc_id long, n long, cls long, bands array<long>")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(cls, shingles) of (doc_id, text); shingles are the sorted 64-bit hashes as bytes."""

    def run(batches):
        for part in _parts(batches, 1):
            sets = _sets(part.column(1), width)
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "shingles"])
        words.trim()

    return docs.mapInArrow(run, "cls long, shingles binary").dropDuplicates(["cls"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            hit = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="mergesort")
                shared = int((both[1:] == both[:-1]).sum())
                hit.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit)], names=["a", "b", "linked"])
        words.trim()

    one = pairs.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("right")), "b")
    two = one.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("left")), "a")
    return two.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, linked boolean")


MASKS = 8


def _spokes(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, cls, lacks, adds, m0 to m7): the difference of a class to its pivot; the bit set holds hashes of what it lacks."""

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(2 + MASKS)]
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                pivot, own = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                lacks = np.setdiff1d(pivot, own, assume_unique=True)
                bits = np.zeros(MASKS, np.uint64)
                spot = lacks % np.uint64(MASKS * 64)
                np.bitwise_or.at(bits, (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
                for column, v in zip(rows, (len(lacks), len(own) - len(pivot) + len(lacks), *bits.astype(np.int64).tolist()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in rows]], names=["pivot", "cls", "lacks", "adds", *[f"m{i}" for i in range(MASKS)]])
        words.trim()

    one = pairs.join(sets.select("cls", F.col("shingles").alias("own")), "cls")
    two = one.join(sets.select(F.col("cls").alias("pivot"), F.col("shingles").alias("theirs")), "pivot")
    return two.select("pivot", "cls", "theirs", "own").mapInArrow(run, "pivot long, cls long, lacks long, adds long, " + ", ".join(f"m{i} long" for i in range(MASKS)))


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(cls, own): how many of a class's shingles no other class has."""

    def run(batches):
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(x, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), c)), pa.array(h)], names=["cls", "h"])
        words.trim()

    single = sets.select("cls", "shingles").mapInArrow(run, "cls long, h long").groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("cls").alias("cls")).filter("c = 1")
    return single.groupBy("cls").agg(F.count(F.lit(1)).alias("own"))


def components(edges: DataFrame, put=materialize) -> DataFrame:
    """(node, root) for the nodes of undirected edges (a, b): root is the least node of the component.

    Alternating large and small stars (Kiveris et al. 2014): each step is a minimum by node and a join, never a list of neighbours.
    """
    edges = put(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = None
    while True:
        # Large star: larger neighbours of u are tied to the least of u and all its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = put(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return _near_duplicates(docs, key, text, width, percent)


def _near_duplicates(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    put = scratch.put
    signed = put(signatures(docs, key, text, width, percent / 100), "neardup-signatures")
    sized = signed.filter("doc_id is not null and cls is not null")
    classes = sized.groupBy("cls").agg(F.min("doc_id").alias("rep"))  # partial minimum before the shuffle
    # One row for each class, and narrow rows for its bands: they are what is shuffled most.
    # The join's key has the id too, so the rows of a hot class go to as many partitions as it has ids.
    kept = sized.join(classes.withColumnRenamed("rep", "doc_id"), ["cls", "doc_id"]).withColumnRenamed("doc_id", "rep")
    single = kept.select("cls", "rep", "n", "bands").dropDuplicates(["cls"])
    banded = single.select("cls", F.explode(F.array_distinct("bands")).alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("band")
    met = put(banded.join(shared, "band"), "neardup-met")
    facts = put(kept.select("cls", "rep", "n").dropDuplicates(["cls"]).join(met.select("cls").distinct(), "cls", "left_semi"), "neardup-classes")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Whole texts stay where they are while the ids of the candidates are few enough to be broadcast; beyond that they are merged.
    reps = facts.select("rep")
    reps = F.broadcast(reps) if facts.count() <= MOST_REPS else reps.hint("merge")
    sets = put(_full_sets(source.join(reps, source.doc_id == reps.rep, "left_semi"), width), "neardup-sets")
    own = put(_own_shingles(sets), "neardup-own")
    # J <= (S - U) / (S + U) for sizes S and own shingles U of both; the partner has n * 100 / percent shingles at most.
    most = F.col("n") + F.col("n") * 100 / percent
    able = (most - F.col("own")) * 100 >= (most + F.col("own")) * percent
    free = facts.join(own, "cls", "left").fillna(0, ["own"]).filter(able).select("cls", "n", "own")
    open_ = met.join(free, "cls")
    pivots = open_.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("own", "cls")).alias("_p")).filter("size > 1").select("band", F.col("_p.cls").alias("pivot"))
    members = put(open_.join(pivots, "band"), "neardup-members")
    labels = checked = None  # labels: (node, root) of classes that are linked so far

    def current() -> DataFrame:
        """Members of keys that hold more than one component, with ``comp``."""
        state = members.withColumn("comp", F.col("cls")) if labels is None else members.join(labels, members.cls == labels.node, "left").withColumn("comp", F.coalesce("root", "cls")).drop("node", "root")
        differ = state.groupBy("band").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a < _b").select("band")
        return state.join(differ, "band", "left_semi")

    for step in ("favourite pivot", "all pivots", "rest"):
        state = put(current(), "neardup-open")
        if state.isEmpty():
            break
        if step == "rest":
            spokes = _spokes(state.filter("cls <> pivot").select("pivot", "cls").distinct(), sets)
            full = put(state.join(spokes, ["pivot", "cls"]), "neardup-spokes")
            x, y = full.alias("x"), full.alias("y")
            both = lambda f: f(*[F.col(f"{side}.{c}") for side in "xy" for c in ("lacks", "adds", "own", "n")])
            bits = sum((F.bit_count(F.col(f"x.m{i}").bitwiseAND(F.col(f"y.m{i}"))) for i in range(MASKS)), F.lit(0))
            spare = lambda side: F.col(f"{side}.lacks") - sum((F.bit_count(F.col(f"{side}.m{i}")) for i in range(MASKS)), F.lit(0))
            # The pivot's shingles that both have, and the most additions that both may share.
            lack_both = F.least(F.col("x.lacks"), F.col("y.lacks"), bits + F.least(spare("x"), spare("y")))
            common = both(lambda la, aa, oa, na, lb, ab, ob, nb: na - aa - lb + lack_both + F.least(aa - oa, ab - ob))
            bound = both(lambda la, aa, oa, na, lb, ab, ob, nb: common * 100 >= (na + nb - common) * percent)
            on = (F.col("x.band") == F.col("y.band")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.comp") != F.col("y.comp")) & bound
            near = x.join(y, on).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
        else:
            near = state.join(state.filter("cls = pivot").select("band", F.col("comp").alias("p_comp"), F.col("n").alias("p_n")), "band")
            near = near.filter((F.col("comp") != F.col("p_comp")) & (F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent))
            if step == "favourite pivot":
                votes = near.groupBy("cls", "pivot").agg(F.count(F.lit(1)).alias("votes"))
                near = votes.groupBy("cls").agg(F.max(F.struct("votes", "pivot")).alias("_x")).select("cls", "_x.pivot")
            near = near.select(F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b")).distinct()
        pairs = near if checked is None else near.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        fresh = put(_confirmed(pairs, sets, percent), "neardup-checked")
        checked = fresh if checked is None else checked.unionByName(fresh)
        new = fresh.filter("linked").select("a", "b")
        if new.isEmpty():
            continue
        if labels is None:
            labels = put(components(new, put), "neardup-labels")
            continue
        # Roots stand for what is already linked.
        for side in ("a", "b"):
            new = new.join(labels.withColumnsRenamed({"node": side, "root": "_root"}), side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
        moved = components(new, put)
        old = labels.join(moved.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
        labels = put(old.unionByName(moved.join(labels.select("node"), "node", "left_anti")), "neardup-labels")
    table = classes if labels is None else classes.join(labels, classes.cls == labels.node, "left").withColumn("root", F.coalesce("root", "cls")).drop("node")
    if labels is not None:
        table = table.join(table.groupBy("root").agg(F.min("rep").alias("component")), "root").select("cls", "component")
    else:
        table = table.select("cls", F.col("rep").alias("component"))
    # Documents without words have no class; they do not meet in one.
    bare = signed.filter("cls is null").select("doc_id", "n", F.lit(None).cast("long").alias("component"))
    out = signed.filter("cls is not null").select("doc_id", "n", "cls").join(table, "cls", "left").select("doc_id", "n", "component").unionByName(bare)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    out = materialize(out, "neardup-result")
    scratch.clear()
    return out


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.85 on three-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=3, percent=85)
