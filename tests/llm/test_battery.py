"""The randomness battery and the false-discovery control of secret scans, held against plain Python."""

import math
import random
import re

from test_native import base_spans

from factloom.llm import secrets


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def verdicts(token):
    """(battery's p-value, p-value under text)."""
    name = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token) else "base32" if re.fullmatch("[A-Z2-7]+=*", token) else "base64"
    alphabet = secrets.ALPHABETS[name]
    body = token.lower() if name == "hex" else token.replace("=", "").replace("-", "+").replace("_", "/")
    v, k, n = [alphabet.index(c) for c in body], len(alphabet), len(body)
    chi = sum((v.count(x) - n / k) ** 2 / (n / k) for x in range(k))
    free = k - 1
    p = [tail(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))]
    mid = (k - 1) / 2
    runs = sum((a > mid) != (b > mid) for a, b in zip(v, v[1:]))
    p.append(2 * tail(abs(runs - (n - 1) / 2) / math.sqrt((n - 1) / 4)))
    for lag in (1, 2, 3, 4):
        r = sum((a - mid) * (b - mid) for a, b in zip(v, v[lag:]))
        p.append(2 * tail(abs(r) / (math.sqrt(n - lag) * (k * k - 1) / 12)))
    equal, triple, change = secrets.TEXT[name]
    kind = lambda x: next((i for i, b in enumerate(secrets.CLASSES[name]) if x < b), None)
    sides = [(kind(a), kind(b)) for a, b in zip(v, v[1:]) if kind(a) is not None and kind(b) is not None]
    same, couples = sum(v.count(x) * (v.count(x) - 1) / 2 for x in set(v)), n * (n - 1) / 2
    z1 = (equal * couples - 0.5 - same) / math.sqrt(couples * (equal - equal**2) + n * (n - 1) * (n - 2) * (triple - equal**2))
    z2 = (sum(a != b for a, b in sides) - 0.5 - len(sides) * change) / math.sqrt(max(len(sides), 1) * change * (1 - change))
    return min(1.0, 6 * min(p)), tail((z1 + z2) / math.sqrt(2))


def random_spans(text):
    """The spans of kind random of a text."""
    found = [(m.start(), m.end(), m[0]) for p in (secrets.TOKEN, secrets.SEGMENT) for m in re.finditer(p, text)]
    tokens = len(re.findall(secrets.TOKEN, text))
    if not found:
        return []
    mean = sum(len(t) for *_, t in found) / len(found)
    judged = [verdicts(t) for *_, t in found]
    q = [p * mean / len(t) for (_, p), (*_, t) in zip(judged, found)]
    limit = max((x for i, x in enumerate(sorted(q), 1) if x <= secrets.ALPHA * i / len(q)), default=-1.0)
    hit = [x <= limit and r >= secrets.GATE for x, (r, _) in zip(q, judged)]
    whole = [f[:2] for f, h in zip(found[:tokens], hit) if h]
    part = [f[:2] for f, h in zip(found[tokens:], hit[tokens:]) if h and not any(a <= f[0] and f[1] <= b for a, b in whole)]
    base = [tuple(map(int, s.split(":")[1:])) for s in base_spans(text).split(",") if s]
    return sorted((a, b) for a, b in whole + part if not any(a < y and x < b for x, y in base))


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.spans for r in secrets.scan(df).collect()}


def test_random_spans_equal_plain_python(spark):
    rng = random.Random(12)
    alphabets = [*secrets.ALPHABETS.values(), "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", "0123456789", "aB1", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]
    made = lambda: "".join(rng.choice(a) for a in [rng.choice(alphabets)] for _ in range(rng.randrange(8, 60)))
    texts = [rng.choice([" ", " é ", "\n"]).join(rng.choice(["/", "-", "=", "", " "]).join(made() for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    got = {i: [(s.start, s.end) for s in spans if s.kind == "random"] for i, spans in scanned(spark, texts).items()}
    assert all(got[i] == random_spans(t) for i, t in enumerate(texts))
    assert sum(map(len, got.values())) > 100


def test_patterns_are_not_random(spark):
    texts = ["Za1" * 8, "Aa0" * 8, "Qk9Qk9a" * 4, "A1b2C3d4E5f6G7h8I9j0K1l2", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef", "z" * 40, "12345678901234567890123456789", "getUserAccountBalanceByIdentifier24"]
    assert all(not spans for spans in scanned(spark, texts).values())


def test_names_and_repeats(spark):
    secret = "q7Zp0LmX2vRt9KsWj4Hd8NbYc3Gf6QeU"
    rows = [(1, f"x {secret} y", 5, "a"), (1, f"x {secret} y", 5, "a"), (2, f"{secret} {secret}", 6, "b")]
    out = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, _more int, _flags string")).collect()
    assert sorted((r.doc_id, r._more, r._flags, len(r.spans)) for r in out) == [(1, 5, "a", 1), (1, 5, "a", 1), (2, 6, "b", 2)]
    long = "word " * 200_000 + secret
    spans = scanned(spark, [long])[0]
    assert [(s.start, s.end) for s in spans] == [(1_000_000, 1_000_000 + len(secret))]
