"""The case store over a stream: each target's last scan is keyed state, so a scan is compared with the one before it without
reading the store again.

State is one value for each target: how many scans it has had, and the last one's fingerprint. Of scans of a target that land
in one batch each is compared with the one before it in (timestamp, scan_id); they are held while they are put in order, so a
batch is bounded by the source (maxFilesPerTrigger). A batch that is run again starts from the state before it and writes the
same rows to the same folder. A new query over a store that has rows begins with the last scan of each target in it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans import history as D
from ..plans.scan import Landed, fingerprints_of, scanned
from ..sources.captures import normalised

FINGERPRINT = "struct<risk_level:string,risk_score:int,exposed:array<string>,cves:array<string>,scam_categories:array<string>,secrets:array<string>,dom_sha256:string>"
_FOUND = f"target_url string, scan_id bigint, timestamp string, id bigint, now {FINGERPRINT}, old {FINGERPRINT}"
#: Of the store that a query writes: the columns of the case store, the scan and what changed.
STORE = D.STORE + ", scan_id bigint, changes string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastScan(StatefulProcessor):
    """(scan_id, timestamp, id, now, old) of each scan of a target; id counts the target's scans."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"id bigint, fingerprint {FINGERPRINT}")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.last.update((initialState["id"], initialState["fingerprint"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        said = self.last.get() if self.last.exists() else None
        n, old = (said[0], said[1]) if said else (0, None)
        for r in sorted(rows, key=lambda r: (r["timestamp"] or "", r["scan_id"])):
            n += 1
            yield Row(target_url=key[0], scan_id=r["scan_id"], timestamp=r["timestamp"], id=n, now=r["fingerprint"], old=old)
            old = r["fingerprint"]
        self.last.update((n, old))

    def close(self) -> None:
        pass


def with_changes(scans: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """STORE's columns of a stream of scans (scan_id, target_url, timestamp, fingerprint). known: a store with earlier ones."""
    first = None
    if known is not None:
        first = known.where("target_url is not null").groupBy("target_url").agg(F.max("id").alias("id"), F.max_by("fingerprint", "id").alias("fingerprint")).groupBy("target_url")
    keyed = scans.where("target_url is not null").select("target_url", "scan_id", "timestamp", "fingerprint").groupBy("target_url")
    found = keyed.transformWithState(_LastScan(), _FOUND, "Append", "None", first)
    said = found.withColumn("changes", D.changes("now", "old"))
    return said.select("id", "target_url", "timestamp", "now.risk_level", "now.risk_score", F.col("now").alias("fingerprint"), D.part_of("target_url").alias("part"), "scan_id", "changes")


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """All scans in a store of any number of queries; None if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(STORE + ", run string, batch bigint").parquet(store)


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its query for good."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def store_scans(scans: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of scans (scan_id, target_url, timestamp, fingerprint) to the store, each with what changed."""
    spark = scans.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the only one with keyed values

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("part").parquet(f"{store}/run={_run_of(spark, checkpoint)}/batch={batch_id}")

    return with_changes(scans, stored(spark, store)).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_stream(captures: DataFrame, store: str, checkpoint: str, landed: Landed = Landed()) -> StreamingQuery:
    """Scans a stream of captures (with a timestamp) and stores them. Advisories, which are looked up by what a scan finds, are
    joined in batches only, so landed holds none."""
    if landed.records is not None:
        raise ValueError("advisory records can't be joined to a stream")
    rows = captures.withColumn("timestamp", F.col("timestamp").cast("string"))
    scans = fingerprints_of(scanned(normalised(rows), landed, keep=("timestamp",)))
    return store_scans(scans.select("scan_id", F.col("url").alias("target_url"), "timestamp", "fingerprint"), store, checkpoint)
