"""Scoring texts with a bigram model of the whole corpus, kept as Elias-Fano tries in shards.

The model is never gathered anywhere: it is as large as its shards, and shards grow in number with the corpus, not in size.

1. Every block of documents (what a task reads at a time) becomes a sequence of word codes, which goes along untouched, and one request for
   each shard: the block's distinct (context, word) pairs of the shard with their counts in training documents. Requests number blocks times shards, so
   no step does anything in Python for each of them.
2. Every shard adds up the counts of all blocks, builds its trie (contexts, monotone pointers, successors, quantised probabilities), writes the levels to
   files of the task's own, maps them, and answers the requests of all blocks from them: a probability code for each pair and
   the count of each context.
3. Every block puts the answers and its sequence together and adds up each document's log probabilities.

A context is a word or the boundary before a text; as every word is followed by a word or the end, a context's count is the word's count, and
the boundary's is the end's. The probability of a word is ``c(vw) / (c(v) + mu) + mu / (c(v) + mu) * p(w)`` (a Dirichlet prior), with
``p(w) = (c(w) + 1) / (N + V + 1)``. The first term is what the trie holds, in ``LEVELS`` steps of its logarithm.

Contexts that are hot in a bounded sample of the documents are dealt over several shards by their successors. The sample only decides where pairs go,
never what they count.

Defined results: a null text is empty and consists of its end alone; a null id is held apart from none (its row is training); repeated rows count as
often as they occur; without training documents every count is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from factloom.llm import words
from factloom.llm.eftrie import Trie
from factloom.llm.neardup import _parts
from factloom.llm.storage import materialize, partitions, shuffles_freed, small_batches

MU = 100.0
LEVELS = 4095
LOWEST = -12.0
SHARD_BYTES = 6_000_000
HOT_ROWS = 2000
BLOCK_BYTES = 6_000_000
BATCH_ROWS = 2000
OUT_BYTES = 1_000_000
#: The boundary: the context of a text's first word, and the end of a text.
BOUNDARY = np.uint64(xxhash.xxh3_64_intdigest(b" "))
LOOKUP_ROWS = 30_000
#: The columns of numbers of a request: contexts by hash with their numbers of successors, successors in 40 bits with their counts; then what goes to
#: hot contexts, told by their places among all hot ones, with their counts in the block. All are bytes, so that rows are read together.
NUMBERS = {
    "heads": np.uint64, "degree": np.uint8, "degree_big": np.uint32, "high": np.uint32, "low": np.uint8, "times": np.uint8, "times_big": np.uint32,
    "told": np.uint32, "told_total": np.uint32, "told_degree": np.uint32, "hot_high": np.uint32, "hot_low": np.uint8, "hot_times": np.uint8, "hot_times_big": np.uint32,
}
_ROW = [("shard", pa.int32()), ("block", pa.string()), ("kind", pa.string()), ("payload", pa.binary())]
ASKED = pa.schema([*_ROW, *[(x, pa.binary()) for x in NUMBERS]])
ANSWERED = pa.schema([*_ROW, *[(x, pa.binary()) for x in ("counts", "counts_big", "codes", "hot_codes")], ("tokens", pa.int64()), ("kinds", pa.int64())])


def press(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each one transposed so that like bytes stand together, all in one frame."""
    head = [len(arrays).to_bytes(1, "little")]
    planes = []
    for a in arrays:
        kind = a.dtype.str[1:].encode()
        head.append(len(kind).to_bytes(1, "little") + kind + len(a).to_bytes(5, "little"))
        planes.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() if len(a) else b"")
    return b"".join(head) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpress(data: bytes) -> list[np.ndarray]:
    kinds, at = [], 1
    for _ in range(data[0]):
        k = data[at]
        kinds.append((np.dtype(data[at + 1 : at + 1 + k].decode()), int.from_bytes(data[at + 1 + k : at + 6 + k], "little")))
        at += 6 + k
    total = sum(kind.itemsize * n for kind, n in kinds)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at:], max_output_size=max(1, total)), np.uint8)
    out, at = [], 0
    for kind, n in kinds:
        part = planes[at : at + kind.itemsize * n]
        out.append(np.ascontiguousarray(part.reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += kind.itemsize * n
    return out


def _narrow(h: np.ndarray) -> list[np.ndarray]:
    """A successor's hash in 40 bits, as two arrays; a context's successors are told apart by them."""
    return [(h >> np.uint64(32)).astype(np.uint32), ((h >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)]


def _wide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 8) | b


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1 to LEVELS of probabilities."""
    step = np.rint((np.log10(p) - LOWEST) / -LOWEST * (LEVELS - 1))
    return (np.clip(step, 0, LEVELS - 1) + 1).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    """Probabilities of codes; 0 for code 0."""
    return np.where(code > 0, 10.0 ** (LOWEST + (code.astype(float) - 1) / (LEVELS - 1) * -LOWEST), 0.0)


def _sequence(code: np.ndarray, n_texts: np.ndarray) -> np.ndarray:
    """All texts as one sequence of codes, framed by code 0."""
    ends = np.cumsum(n_texts, dtype=np.int64) + np.arange(1, len(n_texts) + 1)
    seq = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
    inner = np.ones(len(seq), bool)
    inner[0], inner[ends] = False, False
    seq[inner] = code
    return seq


def _pairs(seq: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pair keys of neighbours in order, pair of each token)."""
    key = seq[:-1].astype(np.int64) * n_codes + seq[1:]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    pair = np.empty(len(key), np.int32)
    pair[order] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], pair


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Row k holds the values from ``bounds[k]`` to ``bounds[k + 1]`` as bytes."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(the values of all rows, one row after the other; how many each row has)."""
    column = pa.concat_arrays(column.chunks or [pa.array([], pa.binary())]) if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return values, np.diff(offsets).astype(np.int64) // np.dtype(kind).itemsize


def _short(values: np.ndarray, bounds: np.ndarray, kind: type, big: type) -> list[pa.Array]:
    """Rows of small numbers: most in the narrow type, whose greatest value stands for the next number of the second column."""
    most = np.iinfo(kind).max
    wide = values >= most
    before = np.zeros(len(values) + 1, np.int64)
    np.cumsum(wide, out=before[1:])
    return [_binary(np.where(wide, most, values).astype(kind), bounds), _binary(values[wide].astype(big), before[bounds])]


def _long(short: np.ndarray, big: np.ndarray) -> np.ndarray:
    """The numbers of :func:`_short`."""
    out = short.astype(big.dtype)
    out[short == np.iinfo(short.dtype).max] = big
    return out


def _batches(n: int, schema: pa.Schema, most: int, **columns) -> Iterator[pa.RecordBatch]:
    """Batches of ``n`` rows of about ``most`` bytes, one row at least; columns that are not given are null."""
    whole = pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)
    size = sum(np.diff(np.frombuffer(c.buffers()[1], np.int32)).astype(np.int64) for c in columns.values() if pa.types.is_binary(c.type)) + 64
    cuts = np.unique([0, *(np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1).tolist(), n]).tolist()
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield whole.slice(lo, hi - lo)


def _asker(shards: int, hot: dict[int, int]):
    """Step one; ``hot``: parts of each hot context by its hash."""
    hot_all = np.array(sorted(hot), np.uint64)
    hot_hash = hot_all[hot_all != BOUNDARY]

    def ask(part: pa.RecordBatch, block: str):
        """Batches of one block's rows: its texts, and one request for each shard that is asked something."""
        counts, codes, known = words.split(part.column(1))
        h = words.hashes(known)
        known = None
        # Codes: 0 the boundary, then words by shard (hot ones last) and hash.
        is_hot = np.isin(h, hot_hash)
        shard = np.where(is_hot, shards, (words.mix(h) % np.uint64(shards)).astype(np.int64))
        order = np.lexsort((h, shard))
        code_of = np.empty(len(h), np.int32)
        code_of[order] = np.arange(1, len(h) + 1, dtype=np.int32)
        h, shard = np.concatenate([[BOUNDARY], h[order]]).astype(np.uint64), np.concatenate([[-1], shard[order]])
        n_codes = len(h)
        code = code_of[codes]
        codes = order = code_of = None
        train = np.asarray(part.column(2).to_numpy(zero_copy_only=False), bool)
        keys, pair = _pairs(_sequence(code, counts), n_codes)
        times = np.bincount(pair[np.repeat(train, counts + 1)], minlength=len(keys)).astype(np.uint32)
        pair = None
        v, w = (keys // n_codes).astype(np.int32), (keys % n_codes).astype(np.int32)
        keys = None
        total = np.bincount(v, weights=times, minlength=n_codes).astype(np.uint32)
        # The boundary and hot contexts: each part goes to the shard of (context, part), with the context's count in this block.
        first_hot = int(np.searchsorted(shard, shards))
        lo, hi = np.searchsorted(v, [1, first_hot])
        wild = np.concatenate([np.arange(lo), np.arange(hi, len(v))])
        wild_codes = np.unique(v[wild])
        parts_of = np.array([hot[int(x)] for x in h[wild_codes]], np.int64)
        n_parts = parts_of[np.searchsorted(wild_codes, v[wild])].astype(np.uint64)
        target = _hot_shard(h[v[wild]], words.mix(h[w[wild]]) % n_parts, shards)
        told_code = np.repeat(wild_codes, parts_of)
        told_part = np.arange(len(told_code)) - np.repeat(np.cumsum(parts_of) - parts_of, parts_of)
        # A context is told to a shard once, even if several of its parts are there.
        told = np.unique(_hot_shard(h[told_code], told_part.astype(np.uint64), shards) * n_codes + told_code)
        target = target * n_codes + v[wild]
        by_target = np.argsort(target, kind="stable")
        wild, target = wild[by_target], target[by_target]
        told_degree = np.bincount(np.searchsorted(told, target), minlength=len(told)).astype(np.uint32)
        told_code = told % n_codes
        data = press(code.astype(np.uint32), counts.astype(np.uint32), np.asarray(part.column(0).fill_null(0), np.int64), np.asarray(part.column(0).is_valid(), bool), train, np.array([n_codes, first_hot], np.int64), wild_codes.astype(np.int64), h[wild_codes], wild.astype(np.uint32))
        code = by_target = None
        yield from _batches(1, ASKED, OUT_BYTES, shard=pa.array([zlib.crc32(block.encode()) % shards], pa.int32()), block=pa.array([block]), kind=pa.array(["text"]), payload=pa.array([data], pa.binary()))
        data = None
        # Where each shard's contexts and pairs begin; shards that are asked nothing have none and get no row.
        edge = np.arange(shards + 1)
        c, t = np.searchsorted(shard, edge), np.searchsorted(told, edge * n_codes)
        p, q = np.searchsorted(v, c), np.searchsorted(target, edge * n_codes)
        asked = np.flatnonzero((np.diff(c) > 0) | (np.diff(t) > 0))
        c, p, t, q = (np.append(x[asked], x[-1]) for x in (c - 1, p - lo, t, q))
        high, low = _narrow(h[w[lo:hi]])
        hot_high, hot_low = _narrow(h[w[wild]])
        degree = _short(np.bincount(v[lo:hi] - 1, minlength=first_hot - 1), c, np.uint8, np.uint32)
        often, hot_often = _short(times[lo:hi], p, np.uint8, np.uint32), _short(times[wild], q, np.uint8, np.uint32)
        yield from _batches(
            len(asked), ASKED, OUT_BYTES, shard=pa.array(asked.astype(np.int32)), block=pa.array([block] * len(asked)), kind=pa.array(["ask"] * len(asked)),
            heads=_binary(h[1:first_hot], c), degree=degree[0], degree_big=degree[1], high=_binary(high, p), low=_binary(low, p), times=often[0], times_big=often[1],
            told=_binary(np.searchsorted(hot_all, h[told_code]).astype(np.uint32), t), told_total=_binary(total[told_code], t), told_degree=_binary(told_degree, t),
            hot_high=_binary(hot_high, q), hot_low=_binary(hot_low, q), hot_times=hot_often[0], hot_times_big=hot_often[1],
        )

    def run(batches):
        from pyspark import TaskContext

        task, block_no = TaskContext.get().partitionId(), 0
        for part in _parts(batches, 1, BLOCK_BYTES):
            yield from ask(part, f"{task}-{block_no}")
            block_no += 1
            words.trim()

    return run


def _hot_shard(context: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    return (words.mix(context + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64)


def _answerer(mu: float, shards: int, hot: dict[int, int]):
    """Step two: one shard's trie, and the answers to all requests. What is done in Python is done for all requests at once, as there are blocks times shards of them."""
    hot_all = np.array(sorted(hot), np.uint64)

    def run(batches):
        blocks: list[str] = []
        got: dict[str, list[np.ndarray]] = {x: [] for x in NUMBERS}
        sizes: dict[str, list[np.ndarray]] = {x: [] for x in ("heads", "low", "hot_low")}
        shard = None
        row = lambda block, kind, data, tokens=0, kinds=0: _batches(1, ANSWERED, OUT_BYTES, shard=pa.array([shard], pa.int32()), block=pa.array([block]), kind=pa.array([kind]), payload=pa.array([data], pa.binary()), tokens=pa.array([tokens]), kinds=pa.array([kinds]))
        for batch in batches:
            shard = batch.column("shard")[0].as_py() if shard is None and batch.num_rows else shard
            is_text = pc.equal(batch.column("kind"), "text")
            for x in batch.filter(is_text).select(["block", "payload"]).to_pylist():
                yield from row(x["block"], "text", x["payload"])  # goes along untouched
            asks = batch.filter(pc.invert(is_text))
            blocks += asks.column("block").to_pylist()
            for x, kind in NUMBERS.items():
                values, n = _flat(asks.column(x), kind)
                got[x].append(values)
                if x in sizes:
                    sizes[x].append(n)
        batch = asks = values = None
        tokens = kinds = 0
        if blocks:
            take = lambda x: np.concatenate(got.pop(x))
            told, n_told = take("told"), take("told_total")
            heads, degree, told_degree = take("heads"), _long(take("degree"), take("degree_big")), take("told_degree")
            contexts, at = np.unique(np.concatenate([heads, hot_all[told]]), return_inverse=True)
            c = np.repeat(at.astype(np.int32), np.concatenate([degree, told_degree]))
            head_at = at[: len(heads)].astype(np.int32)
            heads = degree = told_degree = at = None
            normal = sum(len(x) for x in got["low"])
            word = _wide(np.concatenate([take("high"), take("hot_high")]), np.concatenate([take("low"), take("hot_low")]))
            vocabulary, w = np.unique(word, return_inverse=True)
            word, w = None, w.astype(np.int32)
            times = np.concatenate([_long(take("times"), take("times_big")), _long(take("hot_times"), take("hot_times_big"))])
            count = np.bincount(c, weights=times, minlength=len(contexts)).astype(np.int64)
            shared = np.unique(told)
            totals = np.bincount(told, weights=n_told, minlength=len(hot_all)).astype(np.int64)[shared]
            shared = hot_all[shared]
            count[np.searchsorted(contexts, shared)] = totals
            seen = times > 0
            key = c[seen].astype(np.int64) * len(vocabulary) + w[seen]
            order = np.argsort(key)
            key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            n = np.add.reduceat(times[seen][order].astype(np.int64), np.flatnonzero(new)) if len(key) else np.zeros(0, np.int64)
            key = key[new]
            own_c, own_w = key // len(vocabulary), key % len(vocabulary)
            times = seen = order = new = key = vocabulary = told = n_told = None
            # The trie's files are this task's own: whoever repeats the task builds them anew.
            code = np.empty(len(c), np.uint16)
            with tempfile.TemporaryDirectory() as folder:
                Trie.build(own_c, own_w, quantise(n / (count[own_c] + mu)), len(contexts)).save(folder)
                own_c = own_w = n = None
                trie = Trie.load(folder)
                for lo in range(0, len(c), LOOKUP_ROWS):
                    code[lo : lo + LOOKUP_ROWS] = trie.lookup(c[lo : lo + LOOKUP_ROWS], w[lo : lo + LOOKUP_ROWS])
                del trie
            c = w = None
            bounds = {x: np.concatenate([[0], np.cumsum(np.concatenate(n))]).astype(np.int64) for x, n in sizes.items()}
            head_count = _short(count[head_at], bounds["heads"], np.uint16, np.int64)
            yield from _batches(
                len(blocks), ANSWERED, OUT_BYTES, shard=pa.array([shard] * len(blocks), pa.int32()), block=pa.array(blocks), kind=pa.array(["answer"] * len(blocks)),
                counts=head_count[0], counts_big=head_count[1], codes=_binary(code[:normal], bounds["low"]), hot_codes=_binary(code[normal:], bounds["hot_low"]),
            )
            own = np.ones(len(contexts), bool)
            own[np.searchsorted(contexts, shared)] = False
            tokens, kinds = int(count[own].sum()), int((count[own] > 0).sum())
            # A context with parts in many shards is counted by the shard of its part 0, and told to the blocks from there.
            mine = _hot_shard(shared, np.zeros(len(shared), np.uint64), shards) == shard
            tokens, kinds = tokens + int(totals[mine].sum()), kinds + int((totals[mine] > 0).sum())
            yield from row("", "hot", press(shared[mine], totals[mine]))
        yield from row("", "sum", b"", tokens, kinds)
        contexts = count = head_at = head_count = code = None
        words.trim()

    # Spark tells the streamed form by its annotations.
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _adder(mu: float, n_tokens: int, n_kinds: int, hot_counts: dict[int, int]):
    """Step three: the scores of one block's documents."""

    def run(table: pa.Table) -> pa.Table:
        is_text = pc.equal(table["kind"], "text")
        code, counts, ids, valid, train, head, wild_codes, wild_hash, wild = unpress(table.filter(is_text)["payload"][0].as_py())
        n_codes, first_hot, counts = int(head[0]), int(head[1]), counts.astype(np.int64)
        seq = _sequence(code.astype(np.int32), counts)
        code = None
        keys, pair = _pairs(seq, n_codes)
        count, level = np.zeros(n_codes, np.int64), np.zeros(len(keys), np.uint16)
        v = (keys // n_codes).astype(np.int32)
        keys = None
        count[wild_codes] = [hot_counts.get(int(x), 0) for x in wild_hash]
        # Codes and pairs are in the order of shards, and so are the answers.
        answers = table.filter(pc.invert(is_text)).sort_by("shard")
        count[1:first_hot] = _long(_flat(answers["counts"], np.uint16)[0], _flat(answers["counts_big"], np.int64)[0])
        level[slice(*np.searchsorted(v, [1, first_hot]))] = _flat(answers["codes"], np.uint16)[0]
        level[wild] = _flat(answers["hot_codes"], np.uint16)[0]
        table = answers = None
        seen, back = dequantise(level), mu / (count[v] + mu)
        w = seq[1:]
        base = np.log10((count + 1.0) / (n_tokens + n_kinds + 1.0))[w]
        score = np.log10(seen[pair] + back[pair] * 10.0**base)
        starts = np.cumsum(counts + 1) - (counts + 1)
        total = lambda x: np.add.reduceat(x, starts)
        columns = [pa.array(ids, pa.int64(), mask=~valid), pa.array(~train), pa.array(counts + 1), pa.array(total((count[w] > 0).astype(np.int64))), pa.array(total(base)), pa.array(total(score))]
        seq = pair = v = w = seen = back = base = score = level = None
        words.trim()
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def hot_contexts(sample: DataFrame, shards: int) -> dict[int, int]:
    """Parts of every context that has more than a quarter of a shard's share of the sample's tokens: 4 * shards at most, and the boundary."""

    def count(batches):
        for part in _parts(batches, 0, BLOCK_BYTES):
            n, codes, known = words.split(part.column(0))
            times = np.bincount(codes, minlength=len(known))
            most = np.flatnonzero(times * (8 * shards) >= max(1, times.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([None, *(known[i] for i in most)], pa.string()), pa.array([int(times.sum()), *times[most].tolist()], pa.int64())], names=["word", "n"])

    found = {r["word"]: r["n"] for r in sample.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = found.pop(None, 0) or 1
    hot = {int(words.hashes([w])[0]): -(-n * 4 * shards // total) for w, n in found.items() if n * 4 * shards > total}
    return {h: min(shards, n) for h, n in hot.items()} | {int(BOUNDARY): min(shards, 16)}


def score_documents(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", mu: float = MU) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from the rows for which ``train`` holds."""
    spark = docs.sparkSession
    data = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    size = data.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    shards = max(min(8, partitions(spark)), -(-size["bytes"] // SHARD_BYTES))
    share = min(1.0, HOT_ROWS / max(1, size["n"]))
    with small_batches(spark, BATCH_ROWS):
        hot = hot_contexts(data.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("text"), shards)
    asked = data.mapInArrow(_asker(shards, hot), from_arrow_schema(ASKED))
    # The requests are twice the input, so they must not lie beside the answers' own shuffle.
    with small_batches(spark, BATCH_ROWS), shuffles_freed(spark):
        answered = materialize(asked.groupBy("shard").applyInArrow(_answerer(mu, shards, hot), from_arrow_schema(ANSWERED)), "lm-answers")
    sums = answered.filter("kind = 'sum'").agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    told = [unpress(r["payload"]) for r in answered.filter("kind = 'hot'").select("payload").collect()]  # a number for each hot context
    counts = {x: y for h, n in told for x, y in zip(h.tolist(), n.tolist(), strict=True)}
    n, v = int(sums["n"] or 0), int(sums["v"] or 0)
    blocks = answered.filter("block <> ''").drop("tokens", "kinds")
    out = blocks.groupBy("block").applyInArrow(_adder(mu, n, v, counts), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores every document; learns from those whose crc32 of the id is not 2 modulo 7."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
