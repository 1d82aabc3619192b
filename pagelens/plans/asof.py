"""Joins as of a time: to each row the last state of its key at that time, as two tables in one order instead of a range join.

Both tables are put together and ordered by key and time; a row takes the last state before it. A key with more rows than
HOT_ROWS is cut into ranges of time of about equal size, which are ordered apart; what a range begins with is carried over
from the ranges before it, of which there are few. Hot keys are counted, not guessed: there are at most as many as the rows
hold HOT_ROWS."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
_QUANTILES = 64


def as_of(rows: DataFrame, states: DataFrame, key: str, at: str, since: str, name: str = "state", hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with `name`: a struct of the other columns of states, of the last one of the same key with since <= at; null if there is none.

    Null keys and times meet nothing; of states of one key and time the greatest counts; rows keep their number and columns."""
    said = [c for c in states.columns if c not in (key, since)]
    kept = [c for c in rows.columns if c not in (key, at)]
    kind = rows.schema
    own = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(None).cast("struct<none:int>")
    new = states.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("k"), F.col(since).cast("timestamp").alias("t"), F.lit(0).alias("row"), F.struct(*(F.col(f"`{c}`") for c in said)).alias("state"))
    old = rows.select(F.col(key).alias("k"), F.col(at).cast("timestamp").alias("t"), F.lit(1).alias("row"), own.alias("own"), F.col(at).alias("own_at"))
    both = new.unionByName(old, allowMissingColumns=True)
    hot = both.where("k is not null and t is not null").groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("k")
    of_hot = both.join(F.broadcast(hot), "k").groupBy("k").agg(F.percentile_approx(F.unix_micros("t"), [i / _QUANTILES for i in range(1, _QUANTILES)], 10_000).alias("cuts"))
    cut = both.join(F.broadcast(of_hot), "k", "left").withColumn("range", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.unix_micros("t"))), F.lit(0))).drop("cuts")
    within = Window.partitionBy("k", "range").orderBy("t", "row", "state").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = cut.withColumn("found", F.last("state", ignorenulls=True).over(within))
    ends = cut.where("row = 0").groupBy("k", "range").agg(F.max(F.struct("t", "state"))["state"].alias("end"))
    carried = cut.select("k", "range").distinct().join(ends, ["k", "range"], "left")
    before = Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("begin", F.last("end", ignorenulls=True).over(before)).where("begin is not null").select("k", "range", "begin")
    out = last.where("row = 1").join(carried, ["k", "range"], "left").withColumn("found", F.when(F.col("t").isNotNull(), F.coalesce("found", "begin")))
    columns = [F.col("k").alias(key) if c == key else F.col("own_at").alias(at) if c == at else F.col(f"own.`{c}`") for c in kind.names]
    return out.select(*columns, F.col("found").alias(name))
