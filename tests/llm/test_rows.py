"""The pipeline on rows that share an id or have none."""

from collections import Counter

from common import table

import corpus_pipeline
from factloom.llm import mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def text(k, n=30):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_near_duplicates_go_by_row_and_not_by_id(spark):
    rows = [(1, text(1)), (1, text(2)), (1, text(2)), (2, text(2) + " more"), (3, text(3)), (3, text(4) + " more"), (4, text(4)), (None, text(5)), (None, text(5)), (None, text(6)), (None, text(3)), (7, None), (7, "")]
    rows += [(9, text(100 + k)) for k in range(30)]  # a hot id
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    want = [(1, text(1)), (1, text(2)), (3, text(3)), (3, text(4) + " more"), (None, text(5)), (None, text(6)), (7, None), (7, ""), *rows[13:]]
    assert got == Counter(want)


def test_nulls_in_different_columns_are_different_rows(spark):
    df = spark.createDataFrame([(1, "a", None, "en", 1), (1, "a", "en", None, 1), (None, None, None, None, None)], DOC)
    assert df.select(corpus_pipeline.row_key()).distinct().count() == 3


def test_mixing_counts_rows_without_an_id_apart(spark):
    rows = [(None if k % 2 else 5, text(k, 10 + k % 7), "en", f"s{k % 3}", 1) for k in range(90)] + [(None, text(200, 20), "en", "s0", 1)] * 3
    out = [r for r in corpus_pipeline.mix(spark, spark.createDataFrame(rows, DOC), "").collect()]
    total, taken = Counter(), Counter()
    for _, t, _, s, _ in rows:
        total[s] += len(t.split())
    for r in out:
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - want) <= 20 for s, want in mixing.contract_quotas(dict(total)).items())
    most = Counter(t for _, t, *_ in rows)
    assert all(n <= 3 * most[t] for t, n in Counter(r.text for r in out).items())


def test_no_row_is_lost_by_the_name_of_its_source(spark, tmp_path):
    names = ["a\x1fb", "\x0b", "q\"\\", "é🙂", "\u2028", "\x7f", "/", "", None]
    rows = [(k, text(k, 12), "en", names[k % len(names)], 1) for k in range(90)]
    out = mixing.op4_mix(spark, table(spark, str(tmp_path), "documents", rows, DOC)).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((i, s) for i, _, _, s, _ in rows)


def test_short_texts_keep_all_hashes(spark, tmp_path):
    """Equal texts are alike, others have fingerprints of their own; a hot id's rows are dealt out and still follow each other."""
    from common import same, table

    from factloom.llm import sketch

    texts = [w for k in range(40) for w in (f"w{k}", f"w{k}", f"a{k} b c", f"a{k} b c d e f g", f"x{k} " + " ".join(f"y{i}" for i in range(k)))]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(7, f"hot {i} and {i % 5}", "en", "s", 1) for i in range(300)] + [(None, "n", "en", "s", 1)] * 2
    folder = table(spark, str(tmp_path), "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = sketch.op6_scaled_sketch(spark, folder)
    assert same(out, sketch.OP6_SQL, folder) == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    for k in range(40):
        assert got[5 * k + 1].near_next == 1.0 and got[5 * k].fingerprint == got[5 * k + 1].fingerprint != ""
    short = [i for i in range(len(texts)) if i != 7 and i < 5 * 36]  # 32 shingles at most
    assert len({got[i].fingerprint for i in short}) == len({texts[i] for i in short})
    clash = spark.createDataFrame([(1, "a b", 3, "x"), (2, "a b", 4, "y")], "doc_id long, text string, _part int, _own string")
    assert sorted((r.doc_id, r._part, r._own, r.next_text) for r in sketch.next_texts(clash).collect()) == [(1, 3, "x", "a b"), (2, 4, "y", "a b")]


def test_a_host_with_most_captures_is_dealt_out(spark):
    """Salted or not, the answer is the same, and a pattern that covers every capture is in many parts."""
    from datetime import datetime, timedelta

    from factloom.llm import urlfilter

    begin = datetime(2024, 1, 1)
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i}'}.com/p{i % 7}/x", begin + timedelta(hours=i), "extra") for i in range(600)] + [(5, "http://hot.com/p5/x", begin + timedelta(hours=5), "extra")]
    captures = spark.createDataFrame(rows, "capture_id long, url string, fetched_at timestamp_ntz, pattern string")
    log = [("host:com", "block", begin), ("host:com", "remove", begin + timedelta(days=3)), ("host:hot.com", "allow", begin + timedelta(days=1)), ("host:com", "block", begin + timedelta(days=9)), ("path:hot.com/p1/", "block", begin + timedelta(days=2))]
    entries = spark.createDataFrame(log, "pattern string, action string, at timestamp_ntz")
    plain = sorted(map(str, urlfilter.judge(captures, entries, 10**9).collect()))
    assert sorted(map(str, urlfilter.judge(captures, entries, 10).collect())) == plain and len(plain) == 600
