"""Scans over time: the case store, what a scan is compared by, and what changed since the last one of the same target.

The store is a folder of Parquet, partitioned by a hash of the target, that runs append to. A row: id, target_url, timestamp,
risk_level, risk_score, fingerprint. Ids grow with time; within a batch they follow (timestamp, order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import fixed_values as V
from .risk import filled

PARTS = 64
STORE = "id bigint, target_url string, timestamp string, risk_level string, risk_score int, fingerprint struct<risk_level:string,risk_score:int,exposed:array<string>,cves:array<string>,scam_categories:array<string>,secrets:array<string>,dom_sha256:string>, part int"


def changes(now: str, old: str) -> Column:
    get = lambda side, name: F.col(f"{side}.{name}")
    lines = [F.when(get(old, "risk_level") != get(now, "risk_level"), filled(V.RISK_CHANGED, old=get(old, "risk_level"), new=get(now, "risk_level"), old_score=get(old, "risk_score"), new_score=get(now, "risk_score")))]
    for label, name in V.CHANGED_SETS:
        for verb, a, b in (("New", now, old), ("Resolved", old, now)):
            found = F.array_sort(F.array_except(f"{a}.{name}", f"{b}.{name}"))
            lines.append(F.when(F.size(found) > 0, filled(V.SET_CHANGED, verb=F.lit(verb), label=F.lit(label), items=F.substring(F.concat_ws(", ", found), 1, 200))))
    lines.append(F.when(get(old, "dom_sha256") != get(now, "dom_sha256"), V.CONTENT_CHANGED))
    said = F.concat_ws("\n", *lines)
    return F.when(F.col(old).isNull(), V.FIRST_SCAN).when(said == "", V.NOTHING_CHANGED).otherwise(said)


def diffs(scans: DataFrame) -> DataFrame:
    """(id, target_url, changes) of scans (id, target_url, fingerprint), each against the one before it of its target."""
    df = scans.select("id", "target_url", F.col("fingerprint").alias("now")).withColumn("old", F.lag("now").over(Window.partitionBy("target_url").orderBy("id")))
    return df.select("id", "target_url", changes("now", "old").alias("changes"))


def with_changes(scans: DataFrame, target: str, order: str) -> DataFrame:
    """scans (with fingerprint) with changes: what changed since the one before of the same target."""
    df = scans.withColumn("_old", F.lag("fingerprint").over(Window.partitionBy(target).orderBy(order))).withColumn("_now", F.col("fingerprint"))
    return df.withColumn("changes", changes("_now", "_old")).drop("_now", "_old")


def latest(scans: DataFrame) -> DataFrame:
    """The last scan of each target, combined before the shuffle."""
    return scans.groupBy("target_url").agg(F.max("id").alias("id"), F.max_by("fingerprint.risk_level", "id").alias("risk_level"))


def history(scans: DataFrame, target_url: str) -> DataFrame:
    """A target's scans, newest first; of a store only the target's folder is read."""
    if "part" in scans.columns:
        scans = scans.where(F.col("part") == part_of(F.lit(target_url)))
    return scans.where(F.col("target_url") == target_url).select("id", "fingerprint.risk_level", "fingerprint.risk_score").orderBy(F.desc("id"))


def part_of(target: str | Column) -> Column:
    return F.pmod(F.xxhash64(target), F.lit(PARTS)).cast("int")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path)


def against_store(scans: DataFrame, store: DataFrame) -> DataFrame:
    """(target_url, changes) of new scans (target_url, fingerprint) against the last stored one of each target."""
    last = store.groupBy("part", "target_url").agg(F.max_by("fingerprint", "id").alias("old"))
    both = scans.select("target_url", F.col("fingerprint").alias("now")).withColumn("part", part_of("target_url")).join(last, ["part", "target_url"], "left")
    return both.select("target_url", changes("now", "old").alias("changes"))


def save(scans: DataFrame, path: str, first: int) -> None:
    """Appends scans (target_url, timestamp, fingerprint), with ids from first on in order of time and target.

    first: one more than the store's greatest id, which the caller reads once for the batch."""
    ranges = int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = scans.repartitionByRange(ranges, "timestamp", "target_url").sortWithinPartitions("timestamp", "target_url")
    rows = ordered.select((F.lit(first) + F.monotonically_increasing_id()).alias("id"), "target_url", "timestamp", "fingerprint.risk_level", "fingerprint.risk_score", "fingerprint", part_of("target_url").alias("part"))
    rows.write.mode("append").partitionBy("part").parquet(path)


def next_id(store: DataFrame) -> int:
    return (store.agg(F.max("id")).first()[0] or 0) + 1
