"""Mixing, packing, language ID, nearest neighbours, language model: against brute force, round trips and held-out texts."""

import itertools
import math
import random
import sys
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from common import SF, table
from pyspark.sql import functions as F

from factloom.llm import ann, eftrie, langid, lm, mixing, packing, words

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_targets_are_capped_and_shared_anew():
    sizes = {"a": 100, "b": 10, "c": 0, None: 90}
    got = mixing.capped_targets(sizes, mixing.cycling_weights(sizes))
    assert mixing.cycling_weights(sizes) == {"a": 1, "b": 2, "c": 3, None: 1}
    assert got == {"a": 85.0, "b": 30.0, "c": 0.0, None: 85.0}
    assert mixing.capped_targets({}, {}) == {}


def test_flow_is_of_least_cost():
    rng = random.Random(6)
    for _ in range(30):
        patterns = {("x",): rng.randrange(4), ("y",): rng.randrange(4), ("x", "y"): rng.randrange(4)}
        quotas = {"x": rng.randrange(8), "y": rng.randrange(8)}
        flow = mixing.route(patterns, quotas, passes=2)
        cost = lambda n, size: max(0, n - size)  # the second pass costs one for each token
        sent = lambda s: sum(v.get(s, 0) for v in flow.values())
        best = None
        for a, b, c, d in itertools.product(range(8), repeat=4):
            use = {("x",): a, ("y",): b, ("x", "y"): c + d}
            if a + c <= quotas["x"] and b + d <= quotas["y"] and all(use[p] <= 2 * n for p, n in patterns.items()):
                k = (-(a + b + c + d), sum(cost(use[p], n) for p, n in patterns.items()))
                best = k if best is None else min(best, k)
        assert (-(sent("x") + sent("y")), sum(cost(sum(v.values()), patterns[p]) for p, v in flow.items())) == best


def test_mixing_overlapping_sources(spark):
    rng = random.Random(1)
    kinds = [["a"], ["b"], ["a", "b"], [], None, ["c", "a", "c"]]
    rows = [(i, kinds[i % 6], rng.randrange(0, 30)) for i in range(600)] + [(5, ["a"], 10)] * 3 + [(None, ["b"], 7)]
    df = spark.createDataFrame(rows, "doc_id long, members array<string>, size long")
    quotas = lambda totals: {s: min(n, 1500) for s, n in totals.items()}
    got = mixing.mix(df, "doc_id", "size", "members", quotas).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.copies <= 3 and r.copies == sum(p.copies for p in r.picks)
        for p in r.picks:
            assert p.source in (r.members or [None]) or (not r.members and p.source is None)
            taken[p.source] += p.copies * r.size
    for s in ("a", "b"):
        assert abs(taken[s] - 1500) <= 60
    again = mixing.mix(df.repartition(7), "doc_id", "size", "members", quotas).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.copies) for r in rs)
    assert key(got) == key(again)
    assert mixing.mix(df.limit(0), "doc_id", "size", "members", quotas).count() == 0


def test_mixing_keeps_clashing_names_and_spreads_null_ids(spark):
    rows = [(None, ["a\x0b\x1f\"q"], i % 5, i, "x", 1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, members array<string>, size long, _bucket int, _pattern string, _tokens int, _place int")
    got = mixing.mix(df, "doc_id", "size", "members", lambda totals: {s: n // 2 for s, n in totals.items()}).collect()
    assert sorted(r._bucket for r in got) == list(range(200)) and {(r._pattern, r._tokens, r._place) for r in got} == {("x", 1, 2)}
    assert abs(sum(r.copies * r.size for r in got) - 200) <= 5


def test_op4_comes_near_its_targets(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (i % 40)), "en", f"s{i % 4}" if i % 9 else None, 1) for i in range(2000)] + [(9999, None, None, "s0", None), (10000, "\x1ca b", "en", "big", 1)]
    got = mixing.op4_mix(spark, table(spark, str(tmp_path), "documents", rows, DOC)).collect()
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    assert {r.doc_id: r.size for r in got} == size
    by = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by[r.source] += r.taken
    for r in got:
        assert r.target <= 3 * r.source_size and abs(by[r.source] - r.target) <= 21


@pytest.fixture(scope="module")
def tokenizer():
    return packing.ByteTokenizer(public_tokenizers.path(packing.TOKENIZER), most_known=500)


def test_chunked_tokens_equal_whole_texts(tokenizer):
    rng = random.Random(3)
    alphabet = [*"ab1'é .,\n\t   　日🙂\r​\x85\x1c᠎ ", "'s", " the", "<|endoftext|>", "  "]
    texts = [None, "", " ", "  ", "\n", " a", "a ", "a  b", *["".join(rng.choice(alphabet) for _ in range(rng.randrange(16))) for _ in range(4000)]]
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        got = tokenizer.encode(pa.array(part, pa.string()))
        assert [g.tolist() for g in got] == [tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]


def test_plans_fill_bins_without_gaps():
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.choice([10, 30, 100])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randrange(1, 200)))
        bins, seen = defaultdict(list), set()
        for length, rank, n, first, offset in packing.plan(counts, capacity):
            for i in range(n):
                assert (length, rank + i) not in seen
                seen.add((length, rank + i))
                bins[first + i].append((offset, length))
        assert seen == {(k, i) for k, n in counts.items() for i in range(n)}
        for placed in bins.values():
            at = 0
            for offset, length in sorted(placed):
                assert offset == at
                at += length
            assert at <= capacity and sum(3 * n > capacity for _, n in placed) <= 2
        best_fit = []
        for length in sorted(counts.elements(), reverse=True):
            fit = [i for i, free in enumerate(best_fit) if free >= length]
            if fit:
                best_fit[min(fit, key=lambda i: best_fit[i])] -= length
            else:
                best_fit.append(capacity - length)
        assert len(bins) <= len(best_fit) * 11 / 9 + 1


def test_op8_round_trip(spark, tmp_path, tokenizer):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([None, "", "word " * 5000, "short text", "é" * 3000, " ".join(["a"] * 2047), " ".join(["a"] * 2048)])] + [(7, "same", "en", "s", 1)] * 2 + [(None, "no id", "en", "s", 1)]
    got = packing.op8_pack(spark, table(spark, str(tmp_path), "documents", rows, DOC)).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        ends = list(itertools.accumulate(n for _, n in sorted(placed)))
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert packing.op8_pack(spark, table(spark, str(tmp_path / "none"), "documents", [], DOC)).count() == 0


def test_cuts_leave_only_the_first_piece_short():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)] and packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_op9_held_out_accuracy(spark):
    rows = langid.op9_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) == len(truth)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    rows = [(i, "the cat and the dog are here", "en", "s", 1) for i in range(30)] + [(100 + i, "der hund und die katze sind hier", "de", "s", 1) for i in range(30)]
    train = spark.createDataFrame([*rows, (500, None, "en", "s", 1), (501, "the", None, "s", 1)], DOC)
    model = langid.fit(train)
    asked = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "123 ... 日本語?", 0.5), (4, "1234 !!", 0.5), (5, "die katze", 0.5), (6, "the dog " * 20000, 0.5)], "doc_id long, text string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(asked, model).collect()}
    assert got[1] == got[2] == got[4] == ("und", 0.0) and got[3][0] in ("en", "de")
    assert got[5][0] == "de" and got[6][0] == "en"
    empty = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.predict(asked, empty).collect()} == {"und"}


def plain_model(rows, per_label):
    """The same model in plain Python: TF-IDF of code-point n-grams, FTRL on the sampled rows, the temperature by a fine grid."""
    n, df = len(rows), Counter()
    grams = lambda t: Counter(langid.slots(t).tolist())
    for _, t, _ in rows:
        df.update(set(grams(t)))
    idf = lambda s: math.log((1 + n) / (1 + df[s])) + 1

    def vector(t):
        w = {s: (1 + math.log(c)) * idf(s) for s, c in grams(t).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {s: x / norm for s, x in w.items()}

    labels = sorted({y for *_, y in rows})
    by = {y: [r for r in rows if r[2] == y][:per_label] for y in labels}
    fitted = sorted(((k, labels.index(y), vector(t)) for y in labels for k, (_, t, _) in enumerate(by[y], 1) if k % 5), key=lambda r: r[:2])
    kept = [(labels.index(y), vector(t)) for y in labels for k, (_, t, _) in enumerate(by[y], 1) if not k % 5]
    z, g2 = defaultdict(lambda: [0.0] * len(labels)), defaultdict(lambda: [0.0] * len(labels))
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.02

    def weight(s, k):
        one, two = (l1, l2) if s < langid.SLOTS else (0.0, 0.0)
        return 0.0 if abs(z[s][k]) <= one else -(z[s][k] - math.copysign(one, z[s][k])) / ((beta + math.sqrt(g2[s][k])) / alpha + two)

    def logits(x):
        return [sum(v * weight(s, k) for s, v in {**x, langid.SLOTS: 1.0}.items()) for k in range(len(labels))]

    def soft(a, t=1.0):
        e = [math.exp((v - max(a)) / t) for v in a]
        return [v / sum(e) for v in e]

    order = np.random.default_rng(9)
    for _ in range(4):
        for i in order.permutation(len(fitted)):
            _, y, x = fitted[i]
            x = {**x, langid.SLOTS: 1.0}
            p = soft([sum(v * weight(s, k) for s, v in x.items()) for k in range(len(labels))])
            for s, v in x.items():
                for k in range(len(labels)):
                    g, w = v * (p[k] - (k == y)), weight(s, k)
                    new = g2[s][k] + g * g
                    z[s][k] += g - (math.sqrt(new) - math.sqrt(g2[s][k])) / alpha * w
                    g2[s][k] = new
    slack = 1 / (len(kept) + 2)
    loss = lambda t: -sum((1 - slack) * math.log(soft(logits(x), t)[y]) + slack / (len(labels) - 1) * sum(math.log(v) for k, v in enumerate(soft(logits(x), t)) if k != y) for y, x in kept)
    best = min((math.exp(e / 100) for e in range(-300, 301)), key=loss)
    return lambda t: dict(zip(labels, soft(logits(vector(t)), best), strict=True))


def test_language_equals_plain_python(spark):
    rng = random.Random(3)
    words_ = {"en": "the and of cat house with".split(), "de": "der und das hund haus mit".split(), "fr": "le et du chat maison avec".split()}
    rows = [(i, " ".join(rng.choice(words_[y]) for _ in range(6)), y) for i in range(36) for y in [("en", "de", "fr")[i % 3]]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    place = {r.doc_id: r.h for r in train.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(9)), F.lit(1 << 31)).alias("h")).collect()}
    plain = plain_model(sorted(rows, key=lambda r: place[r[0]]), 400)
    asked = [(100 + i, t) for i, t in enumerate(["the cat", "der hund und", "le chat et la maison", "haus house maison", "xyz"])]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string").withColumn("_guess", F.lit(1)), langid.fit(train)).collect()}
    for i, t in asked:
        p = plain(t)
        assert got[i].lang_pred == max(sorted(p), key=lambda y: p[y]) and abs(got[i].score - max(p.values())) < 0.01 and got[i]._guess == 1


def test_every_label_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + 7 * (i % 210))}{chr(0x4E01 + 7 * (i % 210))} text", f"l{i % 210:03}") for i in range(210 * 6)] + [(None, "same row", "l000")] * 50
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.labels) == 210
    asked = spark.createDataFrame([(k, f"{chr(0x4E00 + 7 * k)}{chr(0x4E01 + 7 * k)}") for k in range(210)], "doc_id long, text string")
    assert sum(r.lang_pred == f"l{r.doc_id:03}" for r in langid.predict(asked, model).collect()) > 200


def test_temperature_is_finite_on_perfect_scores():
    z = np.array([[9.0, -9.0], [-9.0, 9.0]] * 10)
    t = langid.temperature(z, np.array([0, 1] * 10))
    p = langid.softmax(z / t)[0, 0]
    assert 0.9 < p < 0.99


def brute_neighbours(rows, queries, k):
    seen = {(i, tuple(v)) for i, v in rows}
    out = {}
    for q, v in {(i, tuple(v)) for i, v in queries}:
        scored = sorted((-float(np.dot(np.array(v), np.array(x))), i) for i, x in seen if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_neighbours_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(50)] + [rows[3], rows[3]]
    bad = [(200, None), (220, [0.0] * 8), (240, [float("nan")] + [1.0] * 7), (260, [1.0] * 7 + [None]), (280, [1.0] * 5), (None, [1.0] * 8), (300, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_neighbours(rows, [x for x in rows if x[0] % 20 == 0], 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    few = ann.search(df.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert sorted(r.rank for r in few) == [1, 2]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(df.filter("vec_id >= 200"), F.col("vec_id") % 20 == 0).count() == 0


def test_doubles_are_scored_as_doubles(spark):
    v = [(0, [1.0, 1e-9]), (1, [1.04000000080000001, 0.0]), (2, [1.0400000004, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1.0400000008), (2, 1.0400000004)]


def test_neighbours_recall_over_lists(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((6000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 6000, 100):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / (60 * 20) >= 0.9


def test_the_scan_drops_early_but_keeps_the_near():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    q = x[5] + 0.01
    alive = ann.scan(x, q, np.inf, 10)
    near = np.argsort(((x - q) ** 2).sum(1))[:10]
    assert set(near) <= set(alive.tolist()) and len(alive) < 300


def test_queries_of_a_block_are_scanned_together(spark, monkeypatch):
    """Queries number a twentieth of the rows and visit most lists of vectors without structure, so a block must not be scanned for one after the other."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    visits, apply = [], PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, schema: visits.append(f) or apply(self, f, schema))
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64)).astype(np.float32)
    ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:40])], "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=5)
    norms = (x.astype(float) ** 2).sum(1)
    turned = np.column_stack([x, np.sqrt(norms.max() - norms)]).astype(np.float32)
    binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
    left = pa.table({"ids": pa.array([[i, 5000 + i] for i in range(len(x))]), "x": binary(x), "turned": binary(turned)})
    steps = {}
    for m in (20, 400):
        whole = x[:m].astype(float) @ x.T.astype(float)
        bounds = np.sort(norms[:m, None] + norms.max() - 2 * whole, axis=1)[:, 8]
        bounds[::2] = np.inf
        right = pa.table({"q": np.arange(m), "bound": bounds, "x": binary(x[:m]), "turned": binary(np.column_stack([x[:m], np.zeros(m, np.float32)]))})
        done = []
        sys.setprofile(lambda frame, event, arg, done=done: done.append(event) if event.endswith("call") else None)
        try:
            got = visits[0](left, right)
        finally:
            sys.setprofile(None)
        steps[m], found = len(done), defaultdict(list)
        for r in got.to_pylist():
            found[r["q"]].append((r["vec_id"], r["score"]))
        for q in range(m):
            near = np.lexsort((np.arange(len(x)), -whole[q]))[:3].tolist()
            assert [i for i, _ in found[q]] == [i for v in near for i in (v, 5000 + v)]
            assert [s for _, s in found[q]] == pytest.approx(np.repeat(whole[q][near], 2))
    assert steps[400] < 2 * steps[20]


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in itertools.product((1, 2, 50, 5000), (3, 1000, 10**9, 2**40)):
        v = np.sort(rng.integers(0, u, n))
        assert (eftrie.EliasFano.build(v)[np.arange(n)] == v).all()


def test_trie_lookups(tmp_path):
    rng = np.random.default_rng(0)
    for i in range(20):
        nc, nw = int(rng.integers(1, 50)), int(rng.integers(1, 200))
        k = np.unique(rng.integers(0, nc * nw, int(rng.integers(1, 400))))
        folder = tmp_path / str(i)
        folder.mkdir()
        eftrie.Trie.build(k // nw, k % nw, (k % 1000 + 1).astype(np.uint16), nc).save(str(folder))
        q = rng.integers(0, nc * nw, 500)
        assert (eftrie.Trie.load(str(folder)).lookup(q // nw, q % nw) == np.where(np.isin(q, k), q % 1000 + 1, 0)).all()


def brute_scores(rows, train, mu):
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for (i, _), t in zip(rows, tokens, strict=True):
        if train(i):
            uni.update(t)
            bi.update(zip([None, *t], t))
            ctx.update([None, *t[:-1]])
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)
    return [
        (i, not train(i), len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), sum(math.log10((bi[a, w] + mu * p1(w)) / (ctx[a] + mu)) for a, w in zip([None, *t], t)))
        for (i, _), t in zip(rows, tokens, strict=True)
    ]


def test_scores_equal_counting(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "The", "the", "a", "é", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(0, 80)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \t\x0b"), (1003, "the " * 30000)]
    folder = table(spark, str(tmp_path), "documents", [(i, t, "en", "s", 1) for i, t in rows], DOC)
    got = {r.doc_id: tuple(r) for r in lm.op1_lm_score(spark, folder).collect()}
    for want in brute_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2, lm.MU):
        have = got[want[0]]
        assert have[:5] == want[:5]
        assert have[5] == pytest.approx(want[5], rel=1e-9) and abs(have[6] - want[6]) <= 0.002 * want[2]
    nothing = lm.score_documents(spark.createDataFrame(rows[:5], "doc_id long, text string"), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in nothing)
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0


def test_scores_over_many_shards_equal_counting(spark, monkeypatch):
    """A shard for some hundred bytes: nearly all contexts are hot and lie in parts."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "a", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(0, 60)))) for i in range(400)] + [(400, "the the " * 300)]
    monkeypatch.setattr(lm, "SHARD_BYTES", 700)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r) for r in lm.score_documents(docs, F.col("doc_id") % 3 != 0).collect()}
    for want in brute_scores(rows, lambda i: i % 3 != 0, lm.MU):
        have = got[want[0]]
        assert have[:5] == want[:5]
        assert have[5] == pytest.approx(want[5], rel=1e-9) and abs(have[6] - want[6]) <= 0.002 * want[2]


def test_requests_of_many_blocks_are_answered_together(monkeypatch):
    """Requests number blocks times shards, so a shard must not look them up one by one; and no shard gets the texts of all tasks."""
    import pyspark

    shards, hot, rows = 4, {int(lm.BOUNDARY): 4}, []
    for task in range(60):
        monkeypatch.setattr(pyspark.TaskContext, "get", lambda task=task: type("Task", (), {"partitionId": lambda self: task})())
        texts = pa.RecordBatch.from_arrays([pa.array([task]), pa.array([f"a b c{task} d e f"]), pa.array([True])], names=["doc_id", "text", "train"])
        rows += [x for batch in lm._asker(shards, hot)([texts]) for x in batch.to_pylist()]
    assert {x["shard"] for x in rows if x["kind"] == "text"} == set(range(shards))
    calls, lookup = [], eftrie.Trie.lookup
    monkeypatch.setattr(eftrie.Trie, "lookup", lambda self, c, w: calls.append(len(c)) or lookup(self, c, w))
    for s in range(shards):
        own = pa.RecordBatch.from_pylist([x for x in rows if x["shard"] == s], schema=lm.ASKED)
        out = [x for batch in lm._answerer(lm.MU, shards, hot)([own.slice(0, 7), own.slice(7)]) for x in batch.to_pylist()]
        assert sorted(x["block"] for x in out if x["kind"] == "answer") == sorted(x["block"] for x in own.to_pylist() if x["kind"] == "ask")
    assert len(calls) == shards


def test_requests_leave_the_disk_once_answered(spark, monkeypatch):
    """Their shuffle is twice the input; beside the answers and the answers' shuffle it went over the budget unless the driver happened to collect garbage."""
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {p for f in folders for p in Path(f).glob("*/shuffle_*.data")}
    rng, before, left, write = random.Random(4), shuffled(), [], lm.materialize

    def watched(df, name):
        out = write(df, name)
        time.sleep(2)  # files go in the background
        left.append(sum(p.stat().st_size for p in shuffled() - before))
        return out

    monkeypatch.setattr(lm, "materialize", watched)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(400)], "doc_id long, text string")
    assert lm.score_documents(docs, F.col("doc_id") % 3 != 0).count() == 400
    assert len(left) == 1 and left[0] < 100_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_small_numbers_of_rows_and_back():
    values, bounds = np.array([0, 254, 255, 256, 2**32 - 1, 3]), np.array([0, 0, 4, 5, 6])
    short, big = (lm._flat(x, k)[0] for x, k in zip(lm._short(values, bounds, np.uint8, np.uint32), (np.uint8, np.uint32), strict=True))
    assert lm._long(short, big).tolist() == values.tolist()
    assert lm._flat(lm._short(values, bounds, np.uint8, np.uint32)[1], np.uint32)[1].tolist() == [0, 2, 1, 0]


def test_words_are_split_at_ascii_space_only():
    texts = [None, "", " A\tb\x0bC\x0cd\re\n", "É\x1cx\x85y　z "]
    counts, codes, known = words.split(pa.array(texts))
    assert counts.tolist() == [0, 0, 5, 1] and [known[c] for c in codes] == ["a", "b", "c", "d", "e", "É\x1cx\x85y　z "]


def test_driver_tables(spark):
    assert lm.op1_lm_score(spark, SF).count() == packing.op8_pack(spark, SF).select("doc_id").distinct().count() == mixing.op4_mix(spark, SF).count() == 200
