"""The sink of reports: files, digests, what failed attempts leave, runs apart."""

import hashlib
import json
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from pagelens.plans import reports, scan
from pagelens.sources import report_files as R


def files_of(path, run):
    manifest = json.loads((pathlib.Path(path) / run / R.MANIFEST).read_text())
    out = {}
    for part in manifest["parts"]:
        folder = pathlib.Path(path) / run / part["folder"]
        for line in (folder / R.LISTED).read_text().splitlines():
            one = json.loads(line)
            assert hashlib.sha256((folder / one["name"]).read_bytes()).hexdigest() == one["sha256"]
            out[one["name"]] = (folder / one["name"]).read_text()
    assert len(out) == manifest["files"]
    return out


def test_run(spark, tmp_path):
    path = str(tmp_path)
    files = spark.createDataFrame([(f"{i}.json", f"é{i}") for i in range(20)] + [("0.json", "again"), ("plain", None), ("plain", "")], "name string, content string").coalesce(1)
    said = R.write_files(files, path, "one")
    got = files_of(path, "one")
    assert said["files"] == 23 and got["3.json"] == "é3" and got["0.json"] == "é0" and got["0~2.json"] == "again" and got["plain"] == got["plain~2"] == ""
    assert R.verified(path, "one") == []
    with pytest.raises(ValueError, match="there already"):
        R.write_files(files, path, "one")
    # a task that fails leaves no run, and earlier runs as they were
    before = sorted(os.listdir(tmp_path / "one"))
    bad = files.withColumn("content", F.when(F.col("name") == "7.json", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception):
        R.write_files(bad, path, "two")
    assert not os.path.exists(tmp_path / "two" / R.MANIFEST) and sorted(os.listdir(tmp_path / "one")) == before
    assert R.write_files(files, path, "two")["files"] == 23 and len(files_of(path, "two")) == 23
    assert R.write_files(files.limit(0), path, "none")["files"] == 0
    # what was changed since is found
    part = json.loads((tmp_path / "one" / R.MANIFEST).read_text())["parts"][0]["folder"]
    name = json.loads((tmp_path / "one" / part / R.LISTED).read_text().splitlines()[0])["name"]
    (tmp_path / "one" / part / name).write_text("forged")
    assert R.verified(path, "one") == [f"{part}/{name}"]
    (tmp_path / "one" / part / name).unlink()
    assert R.verified(path, "one") == [f"{part}/{name}"]


def test_attempts(tmp_path):
    """Of two attempts of a task only the one that was committed is in the manifest, and the other's folder goes."""
    writer = R._Writer(str(tmp_path), "run")
    lost = writer.write(iter([("a", "1")]))
    kept = writer.write(iter([("a", "1")]))
    assert lost.folder != kept.folder and lost.sha256 == kept.sha256
    writer.commit([kept, None])
    assert sorted(os.listdir(tmp_path / "run")) == sorted([R.MANIFEST, kept.folder]) and list(files_of(tmp_path, "run")) == ["a"]
    other = R._Writer(str(tmp_path), "failed")
    other.write(iter([("a", "1")]))
    other.abort([None])
    assert os.listdir(tmp_path / "failed") == []


def test_reports_of_scans(spark, tmp_path):
    caps = "scan_id bigint, url string, html string, headers map<string,string>, requests array<string>"
    rows = [(i, f"http://a{i}.org/", "<p>x</p>", {}, []) for i in range(6)]
    scans = scan.scanned(spark.createDataFrame(rows, caps)).withColumn("timestamp", F.lit("2026-06-26T01:02:03Z"))
    assert reports.write(scans, str(tmp_path), "r1")["files"] == 12
    got = files_of(tmp_path, "r1")
    one = json.loads(got["report_http___a3.org__20260626010203.json"])
    assert one["target_url"] == "http://a3.org/" and one["intel"]["nameservers"] == [] and one["diff_summary"] == [] and one["threat_intel"] == []
    assert list(one["evidence_sha256"]) == ["dom"] and got["abuse_http___a3.org__20260626010203.txt"].startswith("Request")
    more = scans.withColumns({"changes": F.lit("a\nb"), "screenshot_sha256": F.lit("ff"), "favicon_hash": F.lit("0a")})
    said = json.loads(reports.json_reports(more).first().report)
    assert said["intel"]["favicon_hash"] == "0a" and one["intel"]["favicon_hash"] is None
    assert said["diff_summary"] == ["a", "b"] and said["evidence_sha256"]["screenshot"] == "ff"


def test_manifest_of_files(spark):
    files = spark.createDataFrame([("x/b", bytearray(b"2")), ("w/b", bytearray(b"1")), ("a", bytearray(b""))], "path string, content binary")
    got = {r.name: r.sha256 for r in reports.manifest(files).collect()}
    assert got == {"a": hashlib.sha256(b"").hexdigest(), "b": hashlib.sha256(b"1").hexdigest()}
