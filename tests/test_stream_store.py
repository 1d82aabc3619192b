"""The case store as keyed state: order within a batch, batches that are run again, stores that have rows."""

import os

import pytest

from pagelens.plans import history as D
from pagelens.sources import fixed_values as V
from pagelens.streaming import cases

SCANS = f"scan_id bigint, target_url string, timestamp string, fingerprint {cases.FINGERPRINT}"


def scan(i, target, at, level="Low", score=1, exposed=()):
    return (i, target, at, (level, score, list(exposed), [], [], [], "d"))


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCANS).coalesce(1).write.mode("append").parquet(folder)


def run(spark, landed, store, checkpoint):
    query = cases.store_scans(spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(landed), store, checkpoint)
    query.awaitTermination()
    return sorted((r.target_url, r.id, r.scan_id, r.changes) for r in cases.stored(spark, store).collect())


def test_state(spark, tmp_path):
    landed, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "checkpoint"))
    assert cases.stored(spark, store) is None
    # two scans of a in one batch, landed out of order; ties of time go by scan_id
    land(spark, landed, [scan(2, "a", "2026-01-02", "High", 60), scan(1, "a", "2026-01-01"), scan(3, "b", "2026-01-01"), scan(4, "b", "2026-01-01", exposed=["/x"]), scan(9, None, "2026-01-01")])
    first = run(spark, landed, store, checkpoint)
    changed = V.RISK_CHANGED.format(old="Low", new="High", old_score=1, new_score=60)
    new = V.SET_CHANGED.format(verb="New", label=V.CHANGED_SETS[0][0], items="/x")
    assert first == [("a", 1, 1, V.FIRST_SCAN), ("a", 2, 2, changed), ("b", 1, 3, V.FIRST_SCAN), ("b", 2, 4, new)]
    # a later batch is compared with the state; a batch without anything new changes nothing
    land(spark, landed, [scan(5, "a", "2026-01-03", "High", 60), scan(6, "c", "2026-01-03")])
    second = run(spark, landed, store, checkpoint)
    assert second == sorted([*first, ("a", 3, 5, V.NOTHING_CHANGED), ("c", 1, 6, V.FIRST_SCAN)])
    assert run(spark, landed, store, checkpoint) == second
    # the last batch is run again, as after a crash before its commit: the same rows
    commits = [int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()]
    for name in (f"{max(commits)}", f".{max(commits)}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    assert run(spark, landed, store, checkpoint) == second
    # another query over the store goes on from what it holds
    more = str(tmp_path / "more")
    land(spark, more, [scan(7, "a", "2026-02-01"), scan(8, "d", "2026-02-01")])
    back = V.RISK_CHANGED.format(old="High", new="Low", old_score=60, new_score=1)
    assert run(spark, more, store, str(tmp_path / "other")) == sorted([*second, ("a", 4, 7, back), ("d", 1, 8, V.FIRST_SCAN)])
    every = cases.stored(spark, store)
    assert [r.id for r in D.history(every, "a").collect()] == [4, 3, 2, 1]
    assert {r.target_url: r.id for r in D.latest(every).collect()} == {"a": 4, "b": 2, "c": 1, "d": 1}
    assert "PartitionFilters: [isnotnull(part" in D.history(every, "a")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_captures(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from pagelens.sources.captures import captures

    caps = captures(spark, sf_dir).where("scan_id < 6").withColumn("url", F.lit("http://one.test/")).withColumn("timestamp", F.lit("t"))
    caps.write.parquet(str(tmp_path / "in"))
    cases.store_stream(spark.readStream.schema(caps.schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
    rows = sorted(cases.stored(spark, str(tmp_path / "store")).collect(), key=lambda r: r.id)
    assert [r.scan_id for r in rows] == list(range(6)) and [r.id for r in rows] == list(range(1, 7))
    assert rows[0].changes == V.FIRST_SCAN and all(V.CONTENT_CHANGED in r.changes for r in rows[1:])
    with pytest.raises(ValueError):
        from pagelens.plans.scan import Landed

        cases.store_stream(caps, "", "", Landed(records=caps))
