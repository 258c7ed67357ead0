"""Nearest neighbours by largest inner product: adaptive dimension scan over probed lists.

Vectors get one more dimension that makes the largest inner product the least Euclidean distance, and are turned by a random rotation,
so that any leading part of the dimensions estimates the whole distance. They lie in lists around k-means centres; each list is cut
into blocks of bounded size. The queries of a block scan it together, one column block at a time, by matrix products until few candidates are
left: after each column block, a hypothesis test on the partial distance (Gao and Long 2023) drops every candidate that is, beyond chance, farther than the
query's bound. The bound is the distance of the last neighbour needed among the fitted sample, in the end also that in the block. What
survives all columns is scored in double precision on the original vectors.

Centres, the rotation and the number of probes come from a bounded sample (``fit_rows`` distinct vectors, those with the lowest hashes); the number of
probes is the least that finds ``fit_recall`` of the neighbours inside the sample. All rows are indexed. Equal vectors are one
candidate with its ``k + 1`` smallest ids, which is all that a result can hold of them, so a very common vector is not scanned again and again.

Defined results: vectors that are null, zero or of another length than most, or hold a null or a non-finite number, take no part, nor do null
ids; vectors of doubles are scored as doubles; repeated rows count once; ties go to the smaller id; with fewer candidates than ``k`` all are returned; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.storage import materialize

K = 20
FIT_ROWS = 20_000
FIT_RECALL = 0.97
LIST_ROWS = 1024
#: Sampled vectors for each centre; longer lists are cut into blocks.
FIT_EACH = 8
BLOCK_ROWS = 4096
BLOCK_QUERIES = 8192
COLUMNS = 16
#: Pairs of queries and rows scanned at a time; once fewer than one in ``SPARSE`` is alive the others are not touched any more. Pairs scored at a time.
PAIRS = 1 << 20
SPARSE = 16
SCORED = 1 << 14
#: The test's constant: a candidate at the bound is dropped with a probability far below one in a thousand.
EPSILON = 2.1


@dataclass
class Index:
    top: float  # the largest squared norm
    turn: np.ndarray  # the rotation
    centres: np.ndarray
    probes: int
    sample: np.ndarray  # rotated vectors

    def rotate(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors of one dimension more: rows so that all norms are equal; queries get a zero."""
        x = x.astype(np.float64)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - (x * x).sum(1), 0.0))
        return (np.column_stack([x, more]) @ self.turn).astype(np.float32)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * a @ b.T, 0.0)


def _kmeans(x: np.ndarray, n: int, rng: np.random.Generator, steps: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), n, replace=False)].astype(np.float64)
    for _ in range(steps):
        own = _distances(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=n)[:, None]
        centres = np.where(size > 0, sums / np.maximum(size, 1), centres)
    return centres


def build(sample: np.ndarray, top: float, rows: int, k: int, recall: float = FIT_RECALL, seed: int = 3) -> Index:
    """Fits the index on a sample of ``rows`` distinct vectors."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    turn, upper = np.linalg.qr(rng.standard_normal((d, d)))
    index = Index(top, turn * np.sign(np.diag(upper)), np.zeros((1, d)), 1, np.zeros((0, d), np.float32))
    index.sample = index.rotate(sample)
    lists = max(1, min(rows // LIST_ROWS, len(sample) // FIT_EACH))
    index.centres = _kmeans(index.sample, lists, rng)
    own = _distances(index.sample, index.centres).argmin(1)
    asked = rng.choice(len(sample), min(256, len(sample)), replace=False)
    q = index.rotate(sample[asked], query=True)
    near = np.argsort(_distances(q, index.sample), axis=1)[:, 1 : k + 1]
    place = np.argsort(np.argsort(_distances(q, index.centres), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    if len(needed):
        index.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return index


def scan_all(x: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the block ``x`` that may be among the query's ``k`` nearest: the adaptive scan of all queries ``q``; ``bounds`` are squared distances."""
    d = x.shape[1]
    norms = (x * x).sum(1).max(initial=0.0) + (q * q).sum(1).astype(np.float64)
    slack = lambda r, i=slice(None): r * (1 + 1e-5) + 1e-5 * norms[i] + 1e-9  # noqa: E731 - for sums in another order
    bounds = slack(np.asarray(bounds, np.float64))
    asks = at = None  # the pairs, once few are alive
    far = np.zeros((len(q), len(x)), np.float32)
    for lo in range(0, d, COLUMNS):
        hi = min(lo + COLUMNS, d)
        limit = bounds if hi == d else bounds * (1 + epsilon / np.sqrt(hi)) ** 2 * (hi / d)
        if asks is None:
            # Partial distances of all pairs by one product, as |q|^2 + |x|^2 - 2 q x.
            own, part = q[:, lo:hi], x[:, lo:hi]
            left = np.column_stack([-2.0 * own, (own * own).sum(1), np.ones(len(q), np.float32)]).astype(np.float32)
            far += left @ np.column_stack([part, np.ones(len(x), np.float32), (part * part).sum(1)]).astype(np.float32).T
            keep = ~(far > limit[:, None].astype(np.float32))  # what overflows stays
            if hi == d or np.count_nonzero(keep) * SPARSE < keep.size:
                asks, at = np.nonzero(keep)
                far = far[asks, at].astype(np.float64)
        else:
            part = x[at, lo:hi] - q[asks, lo:hi]
            far += np.einsum("ij,ij->i", part, part)
            keep = ~(far > limit[asks])
            asks, at, far = asks[keep], at[keep], far[keep]
    # The block's own bound: the k-th distance in it.
    order = np.lexsort((far, asks))
    asks, at, far = asks[order], at[order], far[order]
    first = np.searchsorted(asks, np.arange(len(q) + 1))
    last = first[:-1] + k - 1
    there = last < first[1:]
    bounds[there] = np.minimum(bounds[there], slack(far[last[there]], there))
    keep = ~(far > bounds[asks])
    return asks[keep], at[keep]


def scan(x: np.ndarray, q: np.ndarray, bound: float, k: int, epsilon: float = EPSILON) -> np.ndarray:
    """Rows of the block ``x`` that may be among the ``k`` nearest to the one query ``q``."""
    return np.sort(scan_all(x, q[None], np.array([bound]), k, epsilon)[1])


def usable(vector: Column) -> Column:
    """True for a vector that takes part, but for its length."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array | pa.ChunkedArray, kind=np.float32, given=np.float32) -> np.ndarray:
    column = pa.concat_arrays(column.chunks or [pa.array([], pa.binary())]) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(given).reshape(len(column), -1).astype(kind)


def search(table: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, fit_rows: int = FIT_ROWS, fit_recall: float = FIT_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each row for which ``queries`` holds, itself excepted."""
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Original vectors keep their precision; the index is of floats.
    exact, element = (np.float32, "float") if dict(table.dtypes)[vector] == "array<float>" else (np.float64, "double")
    rows = table.filter(queries.isNotNull() & F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{element}>").alias("v"), queries.alias("asks"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return empty
    rows = rows.filter(F.size("v") == lengths["d"])
    # Equal vectors are one row; what precedes the shuffle already keeps no more than k + 1 ids of each.
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    distinct = rows.withColumn("_n", place).filter(F.col("_n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    distinct = materialize(distinct, "ann-distinct")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    found = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("top")).first()
    share = min(1.0, fit_rows / found["n"])
    chosen = distinct.filter(F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").limit(2 * fit_rows)
    sample = np.array([r["v"] for r in chosen.orderBy(F.xxhash64("v")).collect()], exact)
    index = build(sample, float(found["top"]), found["n"], k, fit_recall)
    shared = spark.sparkContext.broadcast(index)  # the sample's size at most

    def assign(batches):
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            turned = own.rotate(x)
            lists = _distances(turned, own.centres).argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(lists), batch.column(1), pa.array([r.tobytes() for r in x]), pa.array([r.tobytes() for r in turned])], names=["list", "ids", "x", "turned"])

    indexed = materialize(distinct.select("v", "ids").mapInArrow(assign, "list int, ids array<long>, x binary, turned binary"), "ann-index")
    asked = rows.filter("asks")
    single = materialize(asked.groupBy("v").agg(F.min("id").alias("q")), "ann-queries")
    n_queries = single.count()
    if not n_queries:
        return empty
    blocks = {r["list"]: -(-r["count"] // BLOCK_ROWS) for r in indexed.groupBy("list").count().collect()}  # a row for each list
    splits = -(-n_queries * index.probes // (len(index.centres) * BLOCK_QUERIES))

    def probe(batches):
        own = shared.value
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), exact).reshape(batch.num_rows, -1)
            for lo in range(0, len(x), 256):
                part, ids = x[lo : lo + 256], batch.column(1).to_pylist()[lo : lo + 256]
                turned = own.rotate(part, query=True)
                near = _distances(turned, own.sample)
                last = min(k, near.shape[1] - 1)  # the query itself may be in the sample
                bounds = np.partition(near, last, axis=1)[:, last] if near.shape[1] > k else np.full(len(part), np.inf)
                lists = np.argsort(_distances(turned, own.centres), axis=1)[:, : own.probes]
                out = [(int(c), b, i % splits, i, float(bounds[j]), part[j].tobytes(), turned[j].tobytes()) for j, i in enumerate(ids) for c in lists[j] for b in range(blocks.get(int(c), 0))]
                columns = zip(*out, strict=True) if out else [[]] * 7
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["list", "block", "split", "q", "bound", "x", "turned"])

    probes = single.select("v", "q").mapInArrow(probe, "list int, block int, split int, q long, bound double, x binary, turned binary")
    many = F.create_map(*[F.lit(v) for pair in blocks.items() for v in pair])
    placed = indexed.withColumn("block", F.pmod(F.xxhash64("x"), many[F.col("list")]).cast("int")).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            x, turned = _matrix(left["x"], np.float64, exact), _matrix(left["turned"])
            asked, rotated = _matrix(right["x"], np.float64, exact), _matrix(right["turned"])
            numbers, bounds = right["q"].to_numpy(), right["bound"].to_numpy()
            lists = left["ids"].combine_chunks()
            ids, n_ids = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            starts = np.cumsum(n_ids) - n_ids
            some = max(1, PAIRS // len(x))
            for lo in range(0, len(asked), some):
                asks, at = scan_all(turned, rotated[lo : lo + some], bounds[lo : lo + some], k + 1)
                asks += lo
                # One sum for each row in a fixed order, so equal vectors have equal scores.
                score = np.concatenate([(x[at[i : i + SCORED]] * asked[asks[i : i + SCORED]]).sum(1) for i in range(0, max(1, len(at)), SCORED)])
                n = n_ids[at]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts[at], n)
                asks, score, found = np.repeat(asks, n), np.repeat(score, n), ids[place]
                order = np.lexsort((found, -score, asks))
                asks, score, found = asks[order], score[order], found[order]
                best = np.arange(len(asks)) - np.searchsorted(asks, asks) <= k
                out.append((numbers[asks[best]], found[best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 3
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["q", "vec_id", "score"])

    keys = ("list", "block", "split")
    hits = placed.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(visit, "q long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r")
    who = asked.select("id", "v").distinct().join(single, "v").select(F.col("id").alias("query_id"), "q")
    each = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = who.join(hits, "q").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(each))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
