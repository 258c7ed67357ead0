"""Random values behind a name or inside a path."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import secrets

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
N = 300


@pytest.mark.parametrize("n", [24, 40])
def test_a_name_or_path_does_not_hide_the_value(spark, n):
    rng = random.Random(n)
    prefixes = ["", "private_key=", "aws_secret_access_key=", "connection-string-value=", "hooks/services/incoming/", "a_rather_long_name_of_a_setting_for_keys="]
    rows = [(k, p, p + "".join(rng.choice(ALPHABET) for _ in range(n)), len(p)) for k, p in enumerate(prefixes) for _ in range(N)]
    df = spark.createDataFrame(rows, "k long, prefix string, text string, at long")
    # The span ends with the value and begins with it or, in a path, with the token.
    whole = F.exists("spans", lambda s: (s["kind"] == "random") & (s["start"] <= F.col("at")) & (s["end"] == F.length("text")))
    found = {r.prefix: r.n / N for r in secrets.scan(df).groupBy("prefix").agg(F.count_if(whole).alias("n")).collect()}
    assert min(found.values()) >= 0.9, found


def test_padding_and_separators(spark):
    texts = {
        "QmFzZTY0IGlzIGZ1biB4eXo9Cg==": ["QmFzZTY0IGlzIGZ1biB4eXo9Cg=="],
        "x ABCDEFGHIJKLMNOPQRSTUV== y": ["ABCDEFGHIJKLMNOPQRSTUV=="],
        "name=ABCDEFGHIJKLMNOPQRSTUVW=": ["ABCDEFGHIJKLMNOPQRSTUVW="],
        "ABCDEFGHIJKLMNOPQRSTUV=": [],
        "ABCDEFGHIJKLMNOPQRSTUVWX=a": ["ABCDEFGHIJKLMNOPQRSTUVWX"],
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.x for r in df.withColumn("x", F.regexp_extract_all("text", F.lit(secrets.TOKEN), F.lit(0))).collect()}
    assert got == texts
    parts = spark.createDataFrame([("a/" + "b" * 24 + "/" + "c" * 30 + "-d " + "e" * 40 + " f=" + "g" * 24 + " k=_" + "h" * 22 + "==",)], "text string")
    assert parts.select(F.regexp_extract_all("text", F.lit(secrets.SEGMENT), F.lit(0)).alias("x")).first().x == ["b" * 24, "c" * 30, "h" * 22 + "=="]
