"""Best-fit packing with large-item matching, on counts of lengths.

Documents become token ids (tokenizers, then one end id); only what is longer than a sequence is cut, the first piece being the shorter
one. Packing sees nothing but how many pieces have each length, at most ``capacity`` numbers however large the corpus is:

1. Of pieces above one third of the capacity at most two share a bin, so those are matched greedily: the longest left with the longest
   that still fits beside it (a pair's partner may be of any such length).
2. Shorter pieces, longest first, go to the smallest gap that holds them (best fit), and to new bins when none does.

Bins of equal content are handled as one run of consecutive numbers, so the plan's size depends on the distinct lengths alone.
The plan says which ranks within a length go to which run at which offset. Ranks are dealt from counts by (length, hash bucket), so no task
sees all pieces of a length.

Defined results: a null text is empty and is packed as the end id alone; repeated rows are separate documents; a null id is kept
as it is; an empty table gives no pieces; ties are ordered by id, then piece, then checksum.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import words
from factloom.llm.storage import materialize, small_batches

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
CHUNK_BYTES = 2_000_000
BATCH_ROWS = 2000


class ByteTokenizer:
    """Ids of texts by a byte-level BPE file of ``tokenizers``; each distinct chunk is encoded once.

    The file's pre-tokenizer never joins a character that is not white space to a space after it, so a text may be cut there:
    chunks are a word with the space before it. Texts in which a space follows white space are encoded whole.
    New distinct chunks are joined to texts of some kilobytes; ids fall to chunks by the byte lengths of tokens. Words stay known to
    the worker process, in Arrow arrays, up to ``most_known``, when it starts anew.
    """

    #: A word that ends in one of these (white space in some reading, by character class or by the file's pattern) may run on into the space.
    OPEN = pa.array([*" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u180e\u200b\u2028\u2029\ufeff"])

    def __init__(self, path: str, most_known: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # one character of the file's alphabet stands for one byte
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most_known = most_known
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())  # words whose chunks are known
        self.ends, self.pool = np.zeros(1, np.int32), np.zeros(0, np.uint32)  # where each chunk's ids end, after a 0; the ids of all

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _numbers(self, words_: pa.Array) -> np.ndarray:
        """Numbers of distinct words, learning those that are new."""
        at = pc.index_in(words_, value_set=self.known)
        new = words_.filter(at.is_null())
        if not len(new):
            return at.to_numpy()
        sizes = pc.binary_length(new).to_numpy().astype(np.int64) + 1
        bounds, texts = list(_blocks(sizes, 16_000)), new.to_pylist()
        found, ends = [self.pool], [self.ends]
        # Only chunks with a space in front may stand behind one another.
        for (lo, hi), encoded in zip(bounds, self.tokenizer.encode_batch_fast([" " + " ".join(texts[lo:hi]) for lo, hi in bounds], add_special_tokens=False), strict=True):
            ids = np.asarray(encoded.ids, np.uint32)
            have, want = np.cumsum(self.bytes_of[ids]), np.cumsum(sizes[lo:hi])
            cuts = np.searchsorted(have, want) + 1
            if not np.array_equal(have[cuts - 1], want):
                raise ValueError("a token crosses a chunk")
            found.append(ids)
            ends.append((ends[-1][-1] + cuts).astype(np.int32))
        first = len(self.known)
        self.pool, self.ends, self.known = np.concatenate(found), np.concatenate(ends), pa.concat_arrays([self.known, new])
        out = pc.fill_null(at, 0).to_numpy().copy()
        out[at.is_null().to_numpy(zero_copy_only=False)] = np.arange(first, first + len(new), dtype=np.int32)
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One array of ids for each text; null is empty."""
        if len(self.known) > self.most_known:
            self._forget()
        texts = pc.fill_null(texts, "")
        pieces = pc.split_pattern(texts, " ")
        ends = pieces.offsets.to_numpy().astype(np.int64) - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        vocabulary, codes = coded.dictionary, coded.indices.to_numpy()
        # A chunk may end here: it is not empty and its last character is no white space in any reading.
        last_sign = pc.utf8_slice_codeunits(vocabulary, -1)
        firm = pc.invert(pc.or_(pc.utf8_is_space(last_sign), pc.or_(pc.equal(vocabulary, ""), pc.is_in(last_sign, value_set=self.OPEN)))).to_numpy(zero_copy_only=False)[codes]
        row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
        first, last = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        first[ends[:-1]], last[ends[1:] - 1] = True, True  # a split text has one piece at least
        soft = np.zeros(len(texts), bool)
        soft[row[~firm & ~last]] = True
        for special in self.special:
            soft |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        shared = firm & ~first & ~soft[row]
        at = codes[shared]
        used = np.zeros(len(vocabulary), bool)
        used[at] = True
        number = np.zeros(len(vocabulary), np.int32)
        number[used] = self._numbers(vocabulary.filter(pa.array(used)))
        at = number[at]
        begin, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        stops = np.cumsum(n, dtype=np.int32)
        ids = self.pool[np.repeat(begin - stops + n, n) + np.arange(int(stops[-1]) if len(stops) else 0, dtype=np.int32)]
        inner = np.split(ids, np.cumsum(np.bincount(row[shared], weights=n, minlength=len(texts)).astype(np.int64))[:-1]) if len(texts) else []
        out: list[np.ndarray] = []
        for i in range(len(texts)):
            if soft[i]:
                out.append(self._ids(texts[i].as_py()))
                continue
            # The first chunk has no space before it; the last, if it ends in white space or is empty, is encoded as it stands.
            a, b = ends[i], ends[i + 1] - 1
            parts = [self._ids(vocabulary[codes[a]].as_py()), inner[i]]
            if b > a and not firm[b]:
                parts.append(self._ids(" " + vocabulary[codes[b]].as_py()))
            out.append(np.concatenate(parts))
        return out


_tools: dict[str, ByteTokenizer] = {}


def tool_of(path: str) -> ByteTokenizer:
    """The tokenizer of this worker process, with the words that its tasks have met so far."""
    if path not in _tools:
        _tools[path] = ByteTokenizer(path)
    return _tools[path]


def _blocks(sizes: np.ndarray, most: int):
    """Ranges of consecutive items of about ``most`` in sum, one item at least."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter than the capacity."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    names = ["piece", "start", "length", "ids_crc32"]
    schema = pa.schema([(key, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.uint32()))] if with_ids else [])])

    def run(batches):
        tool = tool_of(tokenizer)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _blocks(sizes, CHUNK_BYTES):
                part = batch.slice(lo, hi - lo)
                rows: dict = {x: [] for x in (key, *names, "ids")}
                for doc, ids in zip(part.column(0).to_pylist(), tool.encode(part.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for i, (start, n) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + n]
                        for x, v in zip((key, *names), (doc, i, start, n, zlib.crc32(own.tobytes())), strict=True):
                            rows[x].append(v)
                        if with_ids:
                            rows["ids"].append(own)
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
        words.trim()

    ddl = f"{key} long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if with_ids:
        schema = schema.set(5, pa.field("ids", pa.list_(pa.int64())))
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, ddl)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, count, first sequence, offset): ranks [r, r + count) of a length go to sequences [s, s + count)."""
    left, rank, out, bins = Counter(counts), Counter(), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, count)
    open_gaps: list[int] = []  # sorted gaps that have runs

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    def free(gap: int, first: int, n: int) -> None:
        if gap > 0 and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted(x for x in counts if 3 * x > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - a) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else 0
        if b == a:
            n = left[a] // 2
            if not n:  # one is left; the next shorter may still go beside it
                b = next((x for x in reversed(large[:at]) if left[x]), 0)
                n = 1
        else:
            n = min(left[a], left[b]) if b else left[a]
        put(a, n, bins, 0)
        if b:
            put(b, n, bins, a)
        free(capacity - a - b, bins, n)
        bins += n
    for s in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(open_gaps, s)
            if at == len(open_gaps):
                each = capacity // s
                n, rest = divmod(left[s], each)
                for k in range(each if n else 0):
                    put(s, n, bins, k * s)
                free(capacity - each * s, bins, n)
                bins += n
                for k in range(rest):
                    put(s, 1, bins, k * s)
                if rest:
                    free(capacity - rest * s, bins, 1)
                    bins += 1
                break
            gap = open_gaps[at]
            first, n = gaps[gap].pop()
            take = min(n, left[s])
            if take < n:
                gaps[gap].append((first + take, n - take))
            elif not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(at)
            put(s, take, first, capacity - gap)
            free(gap - s, first, take)
    return out


def pack(found: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, buckets: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of :func:`pieces`."""
    df = found.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    cells = df.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = {int(r["length"]): int(r["n"]) for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # one for each length
    spots: dict[int, list] = {}
    for length, r, n, first, offset in plan(counts, capacity):
        spots.setdefault(length, []).append((r, n, first, offset))
    tables = {k: tuple(np.asarray(c, np.int64) for c in zip(*v, strict=True)) for k, v in spots.items()}
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_bucket").orderBy(key, "piece", "ids_crc32")
    ranked = df.withColumn("_rank", F.row_number().over(within)).join(cells, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_base")).drop("_bucket", "_base")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for x in np.unique(n):
            own = n == x
            begin, _, first, offset = tables[int(x)]
            i = np.searchsorted(begin, r[own], side="right") - 1
            seq[own], off[own] = first[i] + r[own] - begin[i], offset[i]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("_spot", place("length", "_rank")).select(*found.columns, "_spot.sequence_id", "_spot.offset")


def pack_documents(docs: DataFrame) -> DataFrame:
    """The pieces of all documents with their places, by the production tokenizer and capacity."""
    with small_batches(docs.sparkSession, BATCH_ROWS, 2 * CHUNK_BYTES):
        found = materialize(pieces(docs), "packing-pieces")
    return pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_pack(spark, sf_dir: str) -> DataFrame:
    """Packs every document."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
