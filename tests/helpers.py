"""Types, facts and operators for tests."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from factloom.operators.base import Aggregator, Capability, Operator, OperatorPolicy, RetryPolicy, RowOperator
from factloom.types import TypeConfig, TypeRegistry

T0 = datetime(2026, 1, 1)
T1, T2 = T0 + timedelta(hours=1), T0 + timedelta(hours=2)
SEED = "session_id string, namespace_id string, type string, value string, retrieved_by string, first_retrieved timestamp_ntz, last_retrieved timestamp_ntz, ins_seq bigint"


def registry() -> TypeRegistry:
    types = TypeRegistry()
    types.define("email", abstract=True)
    types.define("work_email", "email", config=TypeConfig(pii=True))
    types.define("personal_email", "email", config=TypeConfig(pii=True))
    types.define("ip", config=TypeConfig(pii=True))
    types.define("geo", config=TypeConfig(), value="map<string,double>")
    types.define("risk", config=TypeConfig(), value="double")
    types.define("answer", config=TypeConfig(pii=True))
    types.define("trigger", config=TypeConfig(ephemeral=True))
    types.define("tags", config=TypeConfig(), value="array<string>")
    types.define("labels", config=TypeConfig(), value="array<string>", is_set=True)
    return types


def seed(spark, *rows):
    """Rows (session, type, value[, time]); values are JSON."""
    full = [(s, f"ns_{s}", t, v, "seed", at[0] if at else T0, at[0] if at else T0, i) for i, (s, t, v, *at) in enumerate(rows)]
    return spark.createDataFrame(full, SEED)


def operator(name, depends_on=(), produces=(), emit=None, reruns=False, base=Operator, **more):
    """An operator class that emits (type, JSON value) for every runnable session."""
    emit = emit or []
    policy = OperatorPolicy(rerun_on_new_data=reruns, **{k: more.pop(k) for k in ("rerun_on", "max_cycles", "timeout", "retry", "debounce") if k in more})

    def transform(self, ctx):
        out = [ctx.sessions.select("session_id", F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in emit]
        df = ctx.sessions.limit(0).select("session_id", F.lit("").alias("type"), F.lit("").alias("value"))
        for x in out:
            df = df.unionByName(x)
        return df

    body = {"operator_id": name, "policy": policy, "depends_on": depends_on, "produces": produces, **more}
    body.setdefault("transform", transform)
    return type(name, (base,), body)


def facts_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or ("session_id", "type", "value"))).collect())


__all__ = ["SEED", "T0", "T1", "T2", "Aggregator", "Capability", "Operator", "OperatorPolicy", "RetryPolicy", "RowOperator", "facts_of", "operator", "registry", "seed"]
