"""Near duplicates against all pairs of full sets."""

import random

import pytest

from factloom.llm import neardup

SCHEMA = "doc_id long, text string, band string, n long"


def brute(docs, width, percent):
    sets = {}
    for i, text, *_ in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, width, percent):
    rng = random.Random(width)
    base = [f"b{rng.randrange(500)}" for _ in range(120)]
    other = [f"c{rng.randrange(500)}" for _ in range(200)]
    docs = [(i, edited(rng, base, rng.randrange(0, 6)), "x", 1) for i in range(120)]
    docs += [(200 + i, edited(rng, base[:60] + other[:60], rng.randrange(0, 5)), "x", 1) for i in range(40)]
    docs += [(300 + i, " ".join(other), "x", 1) for i in range(30)]
    docs += [(400 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))), "x", 1) for i in range(40)]
    docs += [(500, None, None, None), (501, "", "x", 1), (502, "  \n", "x", 1), (503, "One two", "x", 1), (504, "one  TWO", "x", 1), (505, "é É", "x", 1)]
    want = brute(docs, width, percent)
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(docs, SCHEMA), width=width, percent=percent).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_a_chain_is_one_component(spark):
    # Neighbours are alike, ends are not; the centre of a key meets only some of them.
    words = [f"k{i}" for i in range(400)]
    docs = [(i, " ".join(words[i * 6 : i * 6 + 160]), "x", 1) for i in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame(docs, SCHEMA), width=3, percent=85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, v[1]) for i, v in brute(docs, 3, 85).items()}
    assert {r.component_id for r in got} == {0}


def test_repeated_rows_null_ids_and_nothing(spark):
    text = "one two three four five six"
    docs = [(7, text, "x", 1), (7, text, "x", 1), (9, text, "x", 1), (None, text, "x", 1)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()), key=str)
    assert got == sorted([(7, 7, True), (7, 7, True), (9, 7, False), (None, None, True)], key=str)
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_banding_misses_hardly_any_pair_at_the_threshold():
    for t in (0.8, 0.85, 0.9):
        rows, bands = neardup.banding(t)
        assert (1 - t**rows) ** bands <= neardup.MISS


def test_stars_find_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 101), (102, 100), (103, 103)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100}
