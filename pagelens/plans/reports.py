"""Reports of scanned rows: the whole record as JSON, a draft to those who can take a page down, and a manifest of digests.

Each is a column; write() makes a file of each. Text is drawn up in the row, so nothing is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import slug
from ..sources.fixed_values import ABUSE_DESKS, MOST_NAMED_SIBLINGS
from ..sources.report_files import write_files
from ..sources.rules import RULES, Rules


def name_of(url: Column, timestamp: Column) -> Column:
    """80 characters of the url that file names may hold, and the 14 digits of the time."""
    digits = F.coalesce(F.nullif(F.substring(F.regexp_replace(timestamp, "[^0-9]", ""), 1, 14), F.lit("")), F.lit("report"))
    return F.concat(slug(url, 80, "target"), F.lit("_"), digits)


def _lines(text: Column | str, end: str) -> Column:
    """The parts of a text; none of an empty or null one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), end), lambda x: x != "")


def json_reports(scans: DataFrame, rules: Rules = RULES) -> DataFrame:
    """scans with name and report: all findings in the order found, the verdict, what changed (where scans have changes) and the
    digests of the page and (where they have screenshot_sha256) the screenshot; with favicon_hash, where they have it."""
    drop = lambda found, *names: F.transform(found, lambda x: x.dropFields(*names))
    findings = F.concat(F.transform("weak", lambda w: w.dropFields("label")), F.transform("leaks", lambda w: w.dropFields("label")))
    icon = F.col("favicon_hash") if "favicon_hash" in scans.columns else F.lit(None).cast("string")
    intel = F.struct("domain", "registration.registrar", F.col("registration.abuse_email").alias("registrar_abuse_email"), F.col("registration.created").alias("creation_date"), F.col("age").alias("age_days"), _lines("registration.nameservers", ",").alias("nameservers"), F.col("hosting.provider").alias("hosting_provider"), F.col("hosting.abuse_email").alias("hosting_abuse_email"), "hosting.asn", icon.alias("favicon_hash"), F.col("siblings").alias("related_domains"), F.array_compact(F.array("note")).alias("notes"))
    changes = "changes" if "changes" in scans.columns else F.lit(None).cast("string")
    shot = F.filter(F.array(F.struct(F.lit("screenshot").alias("key"), F.col("screenshot_sha256").alias("value"))), lambda e: e["value"].isNotNull()) if "screenshot_sha256" in scans.columns else None
    dom = F.array(F.struct(F.lit("dom").alias("key"), F.col("dom_sha256").alias("value")))
    said = F.struct(
        F.col("url").alias("target_url"),
        F.col("timestamp").alias("timestamp_utc"),
        F.lit(rules.version).alias("knowledge_version"),
        drop("prints", "emit_ord").alias("tech_stack"),
        drop("cves", "at").alias("cves"),
        drop("hits", "emit_ord").alias("heuristics"),
        F.transform("paths", lambda p: p.withField("exposed", F.lit(True))).alias("misconfigs"),
        findings.alias("security_findings"),
        intel.alias("intel"),
        F.transform("listed", lambda s: F.struct(s.alias("source"), F.lit(True).alias("listed"))).alias("threat_intel"),
        F.col("looks").alias("visual_matches"),
        "risk",
        F.map_from_entries(dom if shot is None else F.concat(dom, shot)).alias("evidence_sha256"),
        _lines(changes, "\n").alias("diff_summary"),
    )
    return scans.withColumns({"name": F.concat(F.lit("report_"), name_of(F.col("url"), F.col("timestamp")), F.lit(".json")), "report": F.to_json(said, {"ignoreNullFields": "false"})})


def abuse_texts(scans: DataFrame) -> DataFrame:
    """scans with name and abuse_text: whom to send it to, who runs the domain and the host, and what was found."""
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    desk = lambda kind, name, mail: F.when(F.col(mail).isNotNull(), F.concat(F.lit(f"  * {kind} ("), known(F.col(name)), F.lit("): "), F.col(mail)))
    exposed = F.array_join("paths.path", ", ")
    scam = F.size(F.filter("hits", lambda h: F.startswith(h["category"], F.lit("scam_")) | h["category"].isin("brand_impersonation", "fake_gateway", "payment_qr")))
    siblings = F.array_join(F.slice("siblings", 1, MOST_NAMED_SIBLINGS), ", ")
    lines = [
        F.lit("Request to take down a page (draft: check before sending)"),
        F.concat(F.lit("Page: "), "url"),
        F.concat(F.lit("Captured at: "), "timestamp"),
        F.concat(F.lit("Verdict: "), "risk.level", F.lit(" ("), "risk.score", F.lit(" of 100)")),
        F.lit("To:"),
        desk("registrar", "registration.registrar", "registration.abuse_email"),
        desk("host", "hosting.provider", "hosting.abuse_email"),
        *(F.lit(f"  * {d}") for d in ABUSE_DESKS),
        F.concat(F.lit("Registrar: "), known(F.col("registration.registrar"))),
        F.concat(F.lit("Domain age: "), known(F.col("age").cast("string")), F.lit(" days (created "), known(F.col("registration.created")), F.lit(")")),
        F.concat(F.lit("Hosted by: "), known(F.col("hosting.provider")), F.coalesce(F.concat(F.lit(" ("), "hosting.asn", F.lit(")")), F.lit(""))),
        F.concat(F.lit("Scam indicators: "), scam),
        F.concat(F.lit("Exposed paths: "), F.size("paths"), F.when(exposed != "", F.concat(F.lit(": "), exposed)).otherwise("")),
        F.concat(F.lit("Threat feeds: "), F.when(F.size("listed") > 0, F.concat(F.lit("listed ("), F.array_join("listed", ", "), F.lit(")"))).otherwise("not listed")),
        F.when(F.size("looks") > 0, F.concat(F.lit("Looks like: "), F.array_join("looks", ", "))),
        F.when(siblings != "", F.concat(F.lit("Shares certificates with: "), siblings)),
        F.lit("Evidence and a manifest of SHA-256 digests are attached. Found by an automatic, passive scan: verify before acting."),
    ]
    return scans.withColumns({"name": F.concat(F.lit("abuse_"), name_of(F.col("url"), F.col("timestamp")), F.lit(".txt")), "abuse_text": F.concat_ws("\n", *lines)})


def manifest(files: DataFrame) -> DataFrame:
    """(name, sha256) of files (path, content), by name; of files with one name the first path."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.groupBy(name.alias("name")).agg(F.min_by(F.sha2("content", 256), "path").alias("sha256"))


def write(scans: DataFrame, folder: str, run: str) -> dict:
    """A JSON report and a draft of each scan, as files of a run under folder; the run's manifest. Scans are read once."""
    both = abuse_texts(json_reports(scans).withColumnRenamed("name", "report_name"))
    file = lambda name, content: F.struct(F.col(name).alias("name"), F.col(content).alias("content"))
    files = both.select(F.explode(F.array(file("report_name", "report"), file("name", "abuse_text"))).alias("f")).select("f.*")
    return write_files(files, folder, run)
