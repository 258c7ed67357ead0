"""Secret scans: fixed patterns, and a battery of randomness tests for tokens that no pattern names. [native]

Candidates are tokens (maximal runs of base64 or URL-safe characters, 24 or more with the padding; ``=`` counts only as padding at the
end, else it parts tokens as in NAME=value) and segments (what stands in a token between ``/``, ``-`` and ``_``, 24 or more too), so that a
natural name or path does not hide the random value beside it. Every candidate gets an inferred encoding (hex, base32
or base64) of its own and a battery of tests of the hypothesis "each symbol is drawn evenly from the alphabet":

* a chi-squared test of uniformity over all symbols of the alphabet (Wilson and Hilferty's approximation of its tail),
* a runs test of symbols in the upper and lower half of the alphabet,
* serial correlations of symbol values at lags one to four.

A candidate that the battery rejects (the least of its six p-values, times six, is below ``GATE``) is not random, whatever else it looks like.
The others are discoveries only against the opposite hypothesis, "this is text": as text repeats its symbols more often and changes between capitals, small letters and
digits less often than random symbols do, the number of equal pairs and of changes of class give a p-value under rates of text (``TEXT``). The false
discoveries of each document are controlled by the Benjamini-Hochberg step-up rule on these p-values, weighted by token length (longer tokens
have more power, so they get more of the error budget). A candidate that is a discovery and passes the battery is reported as kind ``random``, but a
segment of a reported token is not. The decision needs nothing but the document, so the scan is one pass without a shuffle.

Defined results: a null text counts as empty; empty texts and tables give no spans; a null doc_id stays null; whole texts are scanned, however long;
repeated rows are scanned independently; equal candidates of a text are tested alike and each is reported; other columns are kept by :func:`scan`, whatever
their names; a column of the input named ``spans`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.storage import fresh

# The patterns of the base kinds, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
_PAD = r"(?:=+(?![A-Za-z0-9+/=_-]))"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{24,}" + _PAD + r"?|[A-Za-z0-9+/_-]{23}" + _PAD + r"|[A-Za-z0-9+/_-]{22}(?===)" + _PAD + ")"
#: Segments of a token that is longer: a separator stands before or after.
SEGMENT = r"(?<![A-Za-z0-9+])(?:(?<=[/_-])(?:[A-Za-z0-9+]{24,}" + _PAD + r"?|[A-Za-z0-9+]{23}" + _PAD + r"|[A-Za-z0-9+]{22}(?===)" + _PAD + r")|[A-Za-z0-9+]{24,}(?=[/_-]))"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: The first symbol of each class but the first; symbols from the last bound on have no class.
CLASSES = {"hex": (10, 16), "base32": (26, 32), "base64": (26, 52, 62)}
#: What text looks like in each alphabet: how often two of its symbols are equal, how often three are, and how often neighbours differ in class.
TEXT = {"hex": (0.1, 0.01, 0.2), "base32": (0.066, 0.0056, 0.1), "base64": (0.066, 0.0056, 0.3)}
LAGS = (1, 2, 3, 4)
GATE = 0.001
ALPHA = 0.05
SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int>>"


def _positions(text: Column, pattern: str, kind: str, keep: Column | None = None) -> Column:
    """Spans of the pattern's matches, by the lengths of what stands between them; ``keep``: a flag for each match."""
    no = KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    flags = keep if keep is not None else F.transform(found, lambda _: F.lit(True))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        span = F.struct(begin.alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    rows = F.zip_with(F.arrays_zip(found.alias("match"), flags.alias("keep")), F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(gap.alias("gap"), m["match"].alias("match"), m["keep"].alias("keep")))
    spans = F.aggregate(rows, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _normal_tail(z: Column) -> Column:
    """P(N(0,1) > z), by the rational approximation 7.1.26 of Abramowitz and Stegun (error under 1e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _judge(token: Column, encoding: str) -> Column:
    """Struct of ``random`` (the battery's p-value, Bonferroni) and ``text`` (the p-value under rates of text) in this encoding."""
    alphabet, bounds, (equal, triple, change) = ALPHABETS[encoding], CLASSES[encoding], TEXT[encoding]
    size = float(len(alphabet))
    body = F.lower(token) if encoding == "hex" else F.translate(token, "-_=", "+/")
    symbols = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(alphabet)).cast("double") - 1)
    mid = (size - 1) / 2

    def kind(x: Column) -> Column:
        out = F.when(x < bounds[0], 0)
        for i, b in enumerate(bounds[1:], 1):
            out = out.when(x < b, i)
        return out

    def pairs(v: Column) -> Column:
        """Pairs of equal symbols: in sorted order each symbol meets as many equal ones as stand before it."""
        zero = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

        def step(acc: Column, x: Column) -> Column:
            return F.when(x == acc["last"], F.struct(x.alias("last"), (acc["run"] + 1).alias("run"), (acc["sum"] + acc["run"]).alias("sum"))).otherwise(F.struct(x.alias("last"), F.lit(1.0).alias("run"), acc["sum"].alias("sum")))

        return F.aggregate(F.array_sort(v), zero, step, lambda acc: acc["sum"])

    def moved(v: Column, lag: int, f) -> Column:
        return F.zip_with(F.slice(v, F.lit(1), F.size(v) - lag), F.slice(v, F.lit(1 + lag), F.size(v) - lag), f)

    def figures(v: Column) -> Column:
        # A null where a symbol has no class: such neighbours do not count.
        changes = moved(v, 1, lambda a, b: (kind(a) != kind(b)).cast("double"))
        return F.struct(
            F.size(v).cast("double").alias("n"), pairs(v).alias("pairs"), _sum(moved(v, 1, lambda a, b: ((a > mid) != (b > mid)).cast("double"))).alias("runs"),
            _sum(F.transform(changes, lambda x: F.coalesce(x, F.lit(0.0)))).alias("changes"), _sum(F.transform(changes, lambda x: x.isNotNull().cast("double"))).alias("sides"),
            *[_sum(moved(v, lag, lambda a, b: (a - mid) * (b - mid))).alias(f"lag{lag}") for lag in LAGS],
        )

    def tests(f: Column) -> Column:
        n = f["n"]
        couples = n * (n - 1) / 2
        free = size - 1
        chi = F.greatest(size * (n + 2 * f["pairs"]) / n - n, F.lit(0.0))
        uneven = _normal_tail((F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / (2 / (9 * free)) ** 0.5)
        two_sided = lambda z: 2 * _normal_tail(F.abs(z))
        runs = two_sided((f["runs"] - (n - 1) / 2) / F.sqrt((n - 1) / 4))
        serial = [two_sided(f[f"lag{lag}"] / (F.sqrt(n - lag) * F.lit((size * size - 1) / 12))) for lag in LAGS]
        random = F.least(F.least(uneven, runs, *serial) * (2 + len(LAGS)), F.lit(1.0))
        fewer = (equal * couples - 0.5 - f["pairs"]) / F.sqrt(couples * (equal - equal**2) + n * (n - 1) * (n - 2) * (triple - equal**2))
        livelier = (f["changes"] - 0.5 - f["sides"] * change) / F.sqrt(F.greatest(f["sides"], F.lit(1.0)) * (change * (1 - change)))
        return F.struct(random.alias("random"), _normal_tail((fewer + livelier) / F.lit(2.0**0.5)).alias("text"))

    return bound(symbols, lambda v: bound(figures(v), tests))


def judge(token: Column) -> Column:
    """The token's tests in the smallest encoding whose alphabet holds it."""
    return F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), _judge(token, "hex")).when(token.rlike("^[A-Z2-7]+=*$"), _judge(token, "base32")).otherwise(_judge(token, "base64"))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda's body is evaluated for each element, with all that it names."""
    return F.transform(F.array(value), body)[0]


def random_tokens(tokens: Column, alpha: float = ALPHA) -> Column:
    """For each token of the array: true if it passes the battery and is a discovery against text.

    Weighted Benjamini-Hochberg: ``p * mean length / length`` is sorted; the largest one with ``q(k) <= alpha * k / m`` and all
    below it are discoveries. That is one sort for each document, however many tokens it has.
    """

    def judged(q: Column) -> Column:
        n = F.size(q)
        passed = F.transform(F.array_sort(F.transform(q, lambda x: x["q"])), lambda x, i: F.when(x <= F.lit(alpha) * (i + 1) / n, x))
        return bound(F.coalesce(F.array_max(passed), F.lit(-1.0)), lambda limit: F.transform(q, lambda x: (x["q"] <= limit) & (x["random"] >= GATE)))

    tests = F.transform(tokens, lambda t: F.struct(judge(t).alias("p"), F.length(t).cast("double").alias("n")))
    mean = lambda ts: _sum(F.transform(ts, lambda t: t["n"])) / F.size(ts)
    weighted = lambda ts: bound(mean(ts), lambda m: F.transform(ts, lambda t: F.struct((t["p"]["text"] * m / t["n"]).alias("q"), t["p"]["random"].alias("random"))))
    return F.when(F.size(tokens) > 0, bound(tests, lambda ts: bound(weighted(ts), judged))).otherwise(F.expr("cast(array() as array<boolean>)"))


def scan(docs: DataFrame, text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """Adds ``spans``, an array of (start, kind_no, kind, end) in code points, sorted; the end is exclusive."""
    t = F.coalesce(F.col(text), F.lit(""))
    tokens, segments, flags, more, parts = fresh(docs, "tokens", "segments", "flags", "more", "parts")
    strong = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda g: F.length(g) >= 8)
    base = F.array_sort(F.concat(_positions(t, ASSIGN, "assign", strong), _positions(t, ACCESS, "access"), _positions(t, HEX, "hex")))
    found = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    df = docs.withColumn("spans", base).withColumns({tokens: found(TOKEN), segments: found(SEGMENT)})
    df = df.withColumn(flags, random_tokens(F.concat(tokens, segments), alpha))
    of_tokens = F.slice(flags, F.lit(1), F.size(tokens))
    of_segments = F.slice(flags, F.size(tokens) + 1, F.size(segments))
    df = df.withColumns({more: _positions(t, TOKEN, "random", of_tokens), parts: _positions(t, SEGMENT, "random", of_segments)})
    inside = lambda m: F.exists(more, lambda w: (w["start"] <= m["start"]) & (m["end"] <= w["end"]))
    df = df.withColumn(more, F.when(F.size(parts) > 0, F.concat(more, F.filter(parts, lambda m: ~inside(m)))).otherwise(F.col(more)))
    apart = F.filter(more, lambda m: ~F.exists("spans", lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    df = df.withColumn("spans", F.when(F.size(more) > 0, F.array_sort(F.concat("spans", apart))).otherwise(F.col("spans")))
    return df.drop(tokens, segments, flags, more, parts)


def render(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replaces every span of the text (overlapping ones as one) by ``mark``; needs :func:`scan`'s ``spans``, which it drops."""
    t = F.col(text)
    # Merged spans first, then the gaps before and behind them joined once: nothing is copied for each span but its gap.
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("gaps"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        gaps = F.when(s["start"] >= acc["at"], F.concat(acc["gaps"], F.array(gap))).otherwise(acc["gaps"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), gaps.alias("gaps"))

    clean = F.aggregate("spans", zero, step, lambda acc: F.array_join(F.concat(acc["gaps"], F.array(F.substring(t, acc["at"] + 1, F.length(t)))), mark))
    return docs.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(t)).drop("spans")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Base spans and all spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(render(base), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))
