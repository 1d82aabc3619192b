"""Counts of stages against second counts, hooks that fail, and contacts by a recursive query."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagelens.operators import entities, heuristics
from pagelens.operators import landed as N
from pagelens.plans import status
from pagelens.sources.captures import captures


def test_batch(spark, sf_dir):
    told = []

    def hook(stage, counts):
        told.append((stage, counts["rows"]))
        raise RuntimeError("ignored")

    run = status.Status(hook)
    caps = run.watch(captures(spark, sf_dir), "captures", with_url=F.count("url"))
    hits = run.watch(heuristics.lexicon(caps), "lexicon")
    hits.write.format("noop").mode("overwrite").save()
    n, m = captures(spark, sf_dir).count(), heuristics.lexicon(captures(spark, sf_dir)).count()
    assert run.counts() == {"captures": {"rows": n, "with_url": n}, "lexicon": {"rows": m}} and m > 0
    assert told == [("captures", n), ("lexicon", m)]
    with pytest.raises(ValueError):
        run.watch(caps, "lexicon")
    empty = status.Status()
    empty.watch(captures(spark, sf_dir).where("false"), "none").collect()
    assert empty.counts() == {"none": {"rows": 0}}


def test_stream(spark, tmp_path):
    import time

    told = []

    def hook(stage, counts):
        told.append((stage, counts))
        raise RuntimeError("ignored")

    for i in range(3):
        spark.range(10 * (i + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = status.StreamStatus(hook)
    spark.streams.addListener(listener)
    stream = status.watched_stream(spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "landed")
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    for _ in range(100):
        if any(s == "done" for s, _ in told):
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert sum(c["rows"] for s, c in told if s == "landed") == 60
    assert [s for s, _ in told if s != "landed"] == ["started", "done"]


def card(*mails):
    return ["vcard", [["version", {}, "text", "4.0"], *(["email", {}, "text", m] for m in mails)]]


def entity(rnd, depth):
    said = {"roles": rnd.choice([["abuse"], ["registrar"], ["registrar", "abuse"], ["technical"], []])}
    if rnd.random() < 0.5:
        said["vcardArray"] = rnd.choice([card(f"m{rnd.randrange(1000)}@x"), card("a@x", "b@x"), card(), ["vcard"], "odd"])
    if depth and rnd.random() < 0.8:
        said["entities"] = [entity(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    return said


def test_contacts(spark):
    rnd = random.Random(2)
    rows = [(f"k{i}", json.dumps({"entities": [entity(rnd, i % 9) for _ in range(rnd.randint(0, 3))]})) for i in range(60)]
    rows += [("bad", "{"), ("null", None), ("list", "[1]"), ("none", "{}"), ("empty", "")]
    raw = spark.createDataFrame(rows, "key string, body string")
    want = {r.key: r.abuse_email for r in raw.select("key", N._abuse("body").alias("abuse_email")).collect()}
    got = entities.abuse_contacts(raw)
    assert {r.key: r.abuse_email for r in got.collect()} == want and sum(m is not None for m in want.values()) > 20
    assert "Python" not in got._jdf.queryExecution().toString()
    assert entities.abuse_contacts(raw.limit(0)).count() == 0
