"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources. They are aggregated by membership pattern (the sorted set of their sources); each pattern
offers its tokens once for every allowed pass, at a cost that rises with the pass (0, 1, 3, 6, ...), and each source asks for its
quota. A min-cost flow on this small network says how many tokens of each pattern go to each source. The flow of a pattern is then laid
over its documents in a seeded order, pass after pass: a copy is taken if its middle falls inside the flow.

The network has a node for each pattern and source, never for a document; the number of patterns is checked against
``max_patterns``. Running sums go by (pattern, hash bucket), so a source with a third of all rows is spread over all tasks.

Defined results: a null text has size 0 and is never taken; whole texts count, however long; an empty or null membership is the pattern of the null source;
repeated rows are separate copies that count each; rows with a null id are dealt out by their sizes and members; ties of the seeded hash are ordered by id, then size; an
empty table gives an empty result; other columns are kept, whatever their names, but ``picks`` and ``copies`` are replaced.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.storage import fresh, materialize

WORD = r"[^\x20\x09-\x0D]+"
PASSES = 3
SEED = 20


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: dict, weights: dict, most: float = PASSES) -> dict:
    """Shares of all tokens by weight; what a source cannot give in ``most`` passes is shared anew among the others."""
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        open_ -= over
        left = max(0.0, sum(sizes.values()) - sum(out.values()))
    return out


def route(patterns: dict[tuple, int], quotas: dict, passes: int = PASSES) -> dict[tuple, dict]:
    """Min-cost flow from patterns (with their tokens) to sources (with their quotas): tokens by pattern and source.

    Successive shortest paths. Pass k of a pattern is an arc of its own with the pattern's tokens as capacity and k(k+1)/2 as
    cost, so repetition costs are convex and earlier passes fill first.
    """
    names = ["from", *(("p", p) for p in sorted(patterns, key=repr)), *(("s", s) for s in sorted(quotas, key=repr)), "to"]
    no = {x: i for i, x in enumerate(names)}
    arcs: list[list] = []  # head, capacity left, cost; arc i ^ 1 is the way back
    out: list[list[int]] = [[] for _ in names]

    def arc(a, b, capacity: int, cost: int) -> int:
        out[no[a]].append(len(arcs))
        arcs.append([no[b], capacity, cost])
        out[no[b]].append(len(arcs))
        arcs.append([no[a], 0, -cost])
        return len(arcs) - 2

    across = {}
    for p, tokens in patterns.items():
        for k in range(passes):
            arc("from", ("p", p), tokens, k * (k + 1) // 2)
        for s in p:
            if s in quotas:
                across[p, s] = arc(("p", p), ("s", s), passes * tokens, 0)
    for s, quota in quotas.items():
        arc(("s", s), "to", round(quota), 0)
    while True:
        far, came, queue, waits = [float("inf")] * len(names), [-1] * len(names), deque([0]), {0}
        far[0] = 0
        while queue:
            a = queue.popleft()
            waits.discard(a)
            for i in out[a]:
                b, capacity, cost = arcs[i]
                if capacity > 0 and far[a] + cost < far[b]:
                    far[b], came[b] = far[a] + cost, i
                    if b not in waits:
                        waits.add(b)
                        queue.append(b)
        if came[-1] < 0:
            break
        path, at = [], len(names) - 1
        while at:
            path.append(came[at])
            at = arcs[came[at] ^ 1][0]
        push = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= push
            arcs[i ^ 1][1] += push
    flow: dict[tuple, dict] = {p: {} for p in patterns}
    for (p, s), i in across.items():
        if arcs[i ^ 1][1]:
            flow[p][s] = arcs[i ^ 1][1]
    return flow


def mix(docs: DataFrame, key: str, size: str, members: str, quotas: Callable[[dict], dict], passes: int = PASSES, seed: int = SEED, buckets: int = 4096, max_patterns: int = 100_000) -> DataFrame:
    """Adds ``picks`` (array of source and copies) and ``copies`` (their sum).

    ``members``: an array of sources; ``quotas``: from the tokens of every source to the tokens that each shall give.
    """
    spark = docs.sparkSession
    pattern_, place_, bucket_, in_, base_, before_, tokens_, shares_ = fresh(docs, "pattern", "place", "bucket", "in", "base", "before", "tokens", "shares")
    pattern = F.array_sort(F.array_distinct(F.when(F.size(F.coalesce(F.col(members), F.array())) > 0, F.col(members)).otherwise(F.array(F.lit(None).cast("string")))))
    place = F.when(F.col(key).isNull(), F.xxhash64(size, members, F.lit(seed))).otherwise(F.xxhash64(F.col(key).cast("string"), F.lit(seed)))
    df = docs.withColumns({pattern_: F.to_json(pattern), place_: place, bucket_: F.pmod(place, F.lit(buckets)).cast("int")})
    cells = df.groupBy(pattern_, bucket_).agg(F.sum(size).alias(in_))
    found = cells.groupBy(pattern_).agg(F.sum(in_).alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    # The plan is joined by Spark's own JSON: Python would write some control characters in another way.
    names = {tuple(json.loads(r[pattern_])): r[pattern_] for r in found}
    tokens = {tuple(json.loads(r[pattern_])): int(r["n"] or 0) for r in found}
    if len(names) != len(found):
        raise ValueError("two membership patterns read alike")
    totals: dict = {}
    for p, n in tokens.items():
        for s in p:
            totals[s] = totals.get(s, 0) + n
    flows = route(tokens, quotas(totals), passes)
    # For each pattern: its tokens, and where the share of each source begins and ends in its flow.
    rows = []
    for p, given in flows.items():
        ends, at = [], 0
        for s in sorted(given, key=lambda x: (x is None, x or "")):
            ends.append((s, at, at + given[s]))
            at += given[s]
        rows.append((names[p], tokens[p], ends))
    # As many rows as patterns, which were just counted.
    plan = F.broadcast(spark.createDataFrame(rows, f"{pattern_} string, {tokens_} long, {shares_} array<struct<source:string,begin:long,stop:long>>"))
    before = Window.partitionBy(pattern_).orderBy(bucket_).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn(base_, F.coalesce(F.sum(in_).over(before), F.lit(0))).drop(in_)
    running = Window.partitionBy(pattern_, bucket_).orderBy(place_, key, size).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(before_, F.coalesce(F.sum(size).over(running), F.lit(0))).join(cells, [pattern_, bucket_]).join(plan, pattern_)
    middle = lambda k: F.col(base_) + F.col(before_) + F.col(size) / 2 + k * F.col(tokens_)
    copies = lambda s: F.size(F.filter(F.sequence(F.lit(0), F.lit(passes - 1)), lambda k: (F.col(size) > 0) & (middle(k) >= s["begin"]) & (middle(k) < s["stop"])))
    picks = F.filter(F.transform(shares_, lambda s: F.struct(s["source"].alias("source"), copies(s).alias("copies"))), lambda x: x["copies"] > 0)
    df = df.withColumn("picks", picks).withColumn("copies", F.aggregate("picks", F.lit(0), lambda acc, x: acc + x["copies"]))
    return df.drop(pattern_, place_, bucket_, base_, before_, tokens_, shares_)


def cycling_weights(sources, cycle: tuple = (1, 2, 3)) -> dict:
    """Weights 1, 2, 3, repeating, over the sources in code-point order, null last."""
    return {s: cycle[i % len(cycle)] for i, s in enumerate(sorted(sources, key=lambda x: (x is None, x or "")))}


def contract_quotas(sizes: dict) -> dict:
    """The targets of the registered query and the pipeline."""
    return capped_targets(sizes, cycling_weights(sizes))


def op4_mix(spark, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", words(F.col("text")).alias("size"))
    docs = materialize(docs.withColumn("members", F.array("source")), "op4-sizes")
    mixed = mix(docs, "doc_id", "size", "members", contract_quotas)
    by_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = {r["source"]: int(r["source_size"]) for r in by_source.collect()}  # as many rows as sources
    targets = contract_quotas(sizes)
    table = F.broadcast(spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in sizes], "_source string, source_size long, target double"))
    out = mixed.join(table, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source")
