"""A scan from end to end: captures and what landed for them to one row with all findings, the verdict and the fingerprint.

Captures are read and their HTML parsed once; all detectors are expressions over that row. Only what landed elsewhere
(probe, registration, feed, certificate, advisory responses, screenshots) is joined, by scan, host or domain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import is_ipv4, is_loopback, registrable
from ..operators import heuristics as H
from ..operators import landed as N
from ..operators import posture as P
from ..operators import tech as T
from ..sources.rules import RULES, Rules
from . import risk as R

_DOMAIN = "domain string, registrar string, abuse_email string, created string, nameservers string"


@dataclass(frozen=True)
class Landed:
    """What landed responses say, as the operators on them return it; None where nothing landed.

    paths: misconfigurations; registrations: domain_registrations, with the time now for their age; hosting: (host, provider,
    abuse_email, asn); feeds: a table with host for each feed, and sources: their names; looks: visual matches, (scan_id, brand); siblings:
    certificate_siblings; records: advisories; codes: decoded (scan_id, code_type, payload); known: a table of known
    vulnerabilities, in place of the short list."""

    paths: DataFrame | None = None
    registrations: DataFrame | None = None
    now: Column | None = None
    hosting: DataFrame | None = None
    feeds: tuple[DataFrame, ...] = ()
    sources: tuple[str, ...] = ("URLhaus", "Google Safe Browsing")
    looks: DataFrame | None = None
    siblings: DataFrame | None = None
    records: DataFrame | None = None
    codes: DataFrame | None = None
    known: DataFrame | None = None


def analysed(caps: DataFrame, rules: Rules = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(scan_id, url, host, domain, note, dom_sha256, hits, prints, cves, weak, leaks) of captures, and their columns in keep."""
    df = T.with_vulnerabilities(T.with_prints(P.with_weaknesses(H.with_hits(H.prepared(caps), rules), rules), rules))
    blank = (F.col("host") == "") | is_ipv4(F.col("host"))
    return df.select("scan_id", "url", "host", F.when(~blank, registrable(F.col("host"))).alias("domain"), F.when(blank, "Target is a raw IP or has no registrable domain.").alias("note"), F.sha2("html", 256).alias("dom_sha256"), "hits", "prints", "cves", "weak", "leaks", *keep)


def with_landed(df: DataFrame, landed: Landed = Landed()) -> DataFrame:
    """analysed captures with paths, registration, age, hosting, feeds (how many) and listed (which), looks and siblings, empty where nothing landed."""
    spark, none = df.sparkSession, F.array().cast("array<string>")
    path = "struct<path:string,category:string,severity:string>"
    if landed.paths is not None:
        exposed = landed.paths.where("exposed").groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("path", "category", "severity"))).alias("paths"))
        df = df.join(exposed, "scan_id", "left")
    else:
        df = df.withColumn("paths", F.lit(None).cast(f"array<{path}>"))
    if landed.codes is not None:
        codes = H.qr_payloads(landed.codes).groupBy("scan_id").agg(F.collect_list(F.struct(*H.FIELDS)).alias("codes"))
        df = df.join(codes, "scan_id", "left").withColumn("hits", F.concat(F.coalesce("codes", F.slice("hits", 1, 0)), "hits")).drop("codes")
    registrations = landed.registrations if landed.registrations is not None else spark.createDataFrame([], _DOMAIN)
    names = ("created", "registrar", "abuse_email", "nameservers")
    said = F.struct(*(F.col(c) if c in registrations.columns else F.lit(None).cast("string").alias(c) for c in names))
    first = registrations.select("domain", said.alias("r")).groupBy("domain").agg(F.min_by("r", F.struct(F.isnull("r.created"), "r")).alias("registration"))  # one response's, whole
    age = N.age_days("registration.created", landed.now) if landed.now is not None else F.lit(None).cast("int")
    df = df.join(first, "domain", "left").withColumn("age", age)
    kind = "struct<provider:string,abuse_email:string,asn:string>"
    if landed.hosting is not None:
        df = df.join(landed.hosting.groupBy("host").agg(F.min(F.struct("provider", "abuse_email", "asn")).alias("hosting")), "host", "left")
    else:
        df = df.withColumn("hosting", F.lit(None).cast(kind))
    checked = ~is_loopback(F.col("host")) & (F.col("host") != "")  # feeds know nothing of others
    for i, feed in enumerate(landed.feeds):
        source = landed.sources[i] if i < len(landed.sources) else f"feed {i + 1}"
        df = df.join(feed.select("host", F.lit(source).alias(f"feed{i}")).distinct(), "host", "left")
    named = F.array_compact(F.array(*(F.col(f"feed{i}") for i in range(len(landed.feeds))))) if landed.feeds else none
    df = df.withColumn("listed", F.when(checked, named).otherwise(none)).withColumn("feeds", F.size("listed")).drop(*(f"feed{i}" for i in range(len(landed.feeds))))
    for name, table, key, column in (("looks", landed.looks, "scan_id", "brand"), ("siblings", landed.siblings, "domain", "name")):
        if table is None:
            df = df.withColumn(name, none)
            continue
        order = F.struct("ord", column) if "ord" in table.columns else F.struct(column)
        df = df.join(table.groupBy(key).agg(F.array_sort(F.collect_list(order))[column].alias(name)), key, "left").withColumn(name, F.coalesce(name, none))
    if landed.known is not None:
        df = T.with_vulnerability_table(df, landed.known)
    if landed.records is not None:
        df = T.with_advisories(df, landed.records)
    return df.withColumn("paths", F.coalesce("paths", F.array().cast(f"array<{path}>")))


def scanned(caps: DataFrame, landed: Landed = Landed(), rules: Rules = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """All findings and the risk of each capture, and the captures' columns in keep."""
    return R.with_verdict(with_landed(analysed(caps, rules, keep), landed))


def verdicts_of(caps: DataFrame, landed: Landed = Landed(), rules: Rules = RULES) -> DataFrame:
    """(scan_id, score, level, contributions, summary)."""
    return shown(scanned(caps, landed, rules))


def shown(scans: DataFrame) -> DataFrame:
    """The same of scanned rows."""
    return scans.select("scan_id", "risk.score", "risk.level", F.array_join("risk.contributions", "; ").alias("contributions"), "risk.summary")


def fingerprints_of(scans: DataFrame) -> DataFrame:
    """scanned rows with fingerprint: what a later scan of the same target is compared with."""
    exposed, cves = F.array_sort("paths.path"), F.array_sort("cves.cve_id")
    categories, secrets = F.array_sort(F.array_distinct("hits.category")), F.array_sort(F.array_distinct("leaks.evidence"))
    return scans.withColumn("fingerprint", F.struct(F.col("risk.level").alias("risk_level"), F.col("risk.score").alias("risk_score"), exposed.alias("exposed"), cves.alias("cves"), categories.alias("scam_categories"), secrets.alias("secrets"), "dom_sha256"))
