"""The pipeline against plain versions of its stages."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from common import table
from test_native import base_spans
from test_neardup import brute

import corpus_pipeline
from factloom.llm import mixing, packing
from factloom.llm.storage import materialize

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    vocabulary = {"en": [f"the{i}ing" for i in range(300)], "de": [f"sch{i}ung" for i in range(300)]}
    out = []
    for i in range(240):
        lang = ("en", "de")[i % 2]
        out.append((i, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randrange(20, 60))), lang, f"s{i % 3}", 0))
    for i in range(20):  # exact copies, and copies with one word changed
        words = out[i][1].split()
        out.append((300 + i, " ".join(words), out[i][2], "s0", 0))
        words[rng.randrange(len(words))] = "changed"
        out.append((400 + i, " ".join(words), out[i][2], "s1", 0))
    out.append((500, out[40][1] + " password=abcdefgh12345 end", "en", "s2", 0))
    out += [(501, "1234 5678", "en", "s0", 0), (502, None, None, None, None), (503, "", "de", "s1", 0), (7, out[7][1], "en", "s1", 0)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in out]


def test_stages(spark, tmp_path, rows):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "secret scans", "mixing to target weights", "best-fit packing"]
    docs, seen = spark.createDataFrame(rows, DOC), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), "test-stage")
        seen.append(docs.collect())
        if name != "best-fit packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    language, near, clean, mixed, packed = seen
    # Language: all texts with letters stay, whatever they look like.
    assert Counter(r.doc_id for r in language) == Counter(i for i, t, *_ in rows if t and any(map(str.isalpha, t)))
    # Near duplicates: the least id of each component of all pairs, once.
    groups = brute([(r.doc_id, r.text) for r in language], 5, 80)
    assert Counter(r.doc_id for r in near) == Counter(i for i, (_, root) in groups.items() if i == root)
    # Secrets: marked, and nothing else is touched.
    texts = {r.doc_id: r.text for r in near}
    assert {r.doc_id: r.text for r in clean} == {i: t.replace("password=abcdefgh12345", "[secret]") for i, t in texts.items()}
    assert all(not base_spans(r.text) and r.n_chars == len(r.text) for r in clean)
    # Mixing: words of each source near its target, at most three copies.
    size, total, taken = {r.doc_id: len(r.text.split()) for r in clean}, defaultdict(int), defaultdict(int)
    source = {r.doc_id: r.source for r in clean}
    for i, n in size.items():
        total[source[i]] += n
    for r in mixed:
        taken[r.source] += size[r.doc_id]
    for s, target in mixing.contract_quotas(total).items():
        assert abs(taken[s] - target) <= max(size.values())
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    # Packing: every copy is there, bins are gapless and not over capacity.
    pieces = Counter(r.doc_id for r in packed if r.piece == 0)
    assert pieces == Counter(r.doc_id for r in mixed)
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        ends = np.cumsum([n for _, n in sorted(placed)])
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1].tolist()] and ends[-1] <= packing.CAPACITY


def test_run_equals_its_stages(spark, tmp_path, rows):
    folder = table(spark, str(tmp_path), "documents", rows, DOC)
    docs = spark.createDataFrame(rows, DOC)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), "test-run")
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(docs)


def test_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, table(spark, str(tmp_path), "documents", [], DOC)).count() == 0
