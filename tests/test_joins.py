"""Known vulnerabilities by a table, joins as of a time, and the dedupe of findings, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from pagelens.operators import tech as T
from pagelens.operators.arrays import first_of_each
from pagelens.plans.asof import as_of

KNOWN = "i int, part string, prefixes array<string>, cve_id string, kind string, severity string, score double"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_vulnerabilities_by_table(spark):
    entries = [(0, "apache", ["2.4.49", "2.4"], "CVE-1", "cve", "HIGH", 7.5), (1, "pache", ["2."], "CVE-2", "cve", "LOW", 1.0), (2, "", ["9"], "CVE-3", "advisory", "LOW", None), (3, "nginx", [""], "CVE-1", "cve", "LOW", 2.0), (4, "apache", ["2.4"], "CVE-1", "cve", "INFO", 0.0), (5, "é", ["1"], "CVE-5", "cve", "LOW", 1.0), (6, "x" * 80, ["1"], "CVE-6", "cve", "LOW", 1.0)]
    prints = [(1, 5, "Apache", "2.4.49"), (1, 3, "nginx", "1"), (2, 0, "xApacheX", "2.4.490"), (3, 0, "Foo", "9.1"), (4, 0, "apache", None), (4, 1, "apache", ""), (5, 0, "É", "1.0"), (5, 1, "a", "1"), (6, 0, None, "1"), (1, 5, "Apache", "2.4.49")]
    want = {}
    for scan, order, product, version in sorted(prints, key=str):
        for i, part, prefixes, cve, kind, severity, score in entries:
            if version and product is not None and part in product.lower() and any(version.startswith(p) for p in prefixes):
                row = ((order, i), cve, kind, severity, score, f"{product} {version}")
                old = want.setdefault(scan, {}).get(cve)
                want[scan][cve] = min(old, row) if old else row
    got = T.vulnerabilities_by_table(spark.createDataFrame(prints, "scan_id bigint, emit_ord bigint, product string, version string"), spark.createDataFrame(entries, KNOWN))
    assert {r.scan_id: sorted((tuple(c.at), *tuple(c)[1:]) for c in r.cves) for r in got.collect()} == {s: sorted(x.values()) for s, x in want.items()}
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    empty = spark.createDataFrame([], KNOWN)
    assert T.vulnerabilities_by_table(spark.createDataFrame(prints, "scan_id bigint, emit_ord bigint, product string, version string"), empty).count() == 0


def test_a_large_table(spark):
    known = spark.range(200_000).select(F.col("id").cast("int").alias("i"), F.concat(F.lit("product"), F.col("id")).alias("part"), F.array(F.lit("1."), F.lit("2.0")).alias("prefixes"), F.concat(F.lit("CVE-"), F.col("id")).alias("cve_id"), F.lit("cve").alias("kind"), F.lit("LOW").alias("severity"), F.lit(1.0).alias("score"))
    prints = spark.createDataFrame([(1, 0, "Product1999", "1.5"), (2, 0, "product77777", "2.1")], "scan_id bigint, emit_ord bigint, product string, version string")
    got = {r.scan_id: {c.cve_id for c in r.cves} for r in T.vulnerabilities_by_table(prints, known).collect()}
    assert got == {1: {"CVE-1", "CVE-19", "CVE-199", "CVE-1999"}}


@pytest.mark.parametrize("hot_rows", [1_000_000, 40, 1])
def test_as_of(spark, hot_rows):
    rnd = random.Random(hot_rows)
    at = lambda n: f"2026-01-01 00:{n // 60:02}:{n % 60:02}"
    states = [(rnd.choice("aab"), at(rnd.randrange(600)), rnd.randrange(50), rnd.choice([None, "x"])) for _ in range(200)] + [(None, at(1), 1, "x"), ("a", None, 1, "x")]
    rows = [(i, rnd.choice(["a", "a", "b", "c"]), at(rnd.randrange(600)), "y") for i in range(300)] + [(900, None, at(5), "y"), (901, "a", None, "y"), (0, "a", at(300), "y")]
    want = []
    key = lambda s: (s[1], s[2], s[3] or "")
    for i, k, t, y in rows:
        fit = [s for s in states if k is not None and t is not None and s[0] == k and s[1] is not None and s[1] <= t]
        best = max(fit, key=key) if fit else None
        want.append((i, k, t, y, tuple(best[2:]) if best else None))
    left = spark.createDataFrame(rows, "id int, k string, at string, state string").withColumn("at", F.to_timestamp("at"))
    right = spark.createDataFrame(states, "k string, since string, n int, m string").withColumn("since", F.to_timestamp("since"))
    got = as_of(left.repartition(5), right.repartition(3), "k", "at", "since", "found", hot_rows)
    assert got.columns == ["id", "k", "at", "state", "found"]
    say = lambda r: (r.id, r.k, r.at and str(r.at), r.state, r.found and tuple(r.found))
    assert sorted(map(say, got.collect()), key=str) == sorted(want, key=str)
    assert "NestedLoop" not in plan_of(got)
    assert as_of(left.limit(0), right, "k", "at", "since").count() == 0 and as_of(left, right.limit(0), "k", "at", "since", "found").where("found is null").count() == len(rows)


def test_first_of_each(spark):
    rnd = random.Random(1)
    lists = [[(rnd.choice(["a", "b", None]), rnd.randrange(3), i) for i in range(rnd.randrange(12))] for _ in range(60)] + [[]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, f array<struct<k:string,l:int,n:int>>")
    got = df.select("id", first_of_each("f", lambda x: F.struct(x["k"], x["l"])).alias("g")).collect()
    for r in got:
        seen, want = set(), []
        for x in lists[r.id]:
            if x[:2] not in seen:
                seen.add(x[:2])
                want.append(x)
        assert [tuple(x) for x in r.g] == want
    long = spark.range(1).select(F.expr("transform(sequence(1, 100000), i -> named_struct('k', CAST(i % 50000 AS STRING), 'l', 0))").alias("f"))
    assert long.select(F.size(first_of_each("f", lambda x: F.struct(x["k"], x["l"])))).first()[0] == 50_000  # linear, but for the sort


def test_registration_is_one_response(spark):
    from pagelens.plans.scan import Landed, analysed, with_landed

    caps = spark.createDataFrame([(1, "http://a.org/", "", {}, [])], "scan_id bigint, url string, html string, headers map<string,string>, requests array<string>")
    said = [("a.org", "2020-01-02", "first", None, "z"), ("a.org", "2021-01-01", "a second", "m@x", "b"), ("a.org", None, "0", "a@a", "a")]
    got = with_landed(analysed(caps), Landed(registrations=spark.createDataFrame(said, "domain string, created string, registrar string, abuse_email string, nameservers string"))).first()
    assert tuple(got.registration) == ("2020-01-02", "first", None, "z")
