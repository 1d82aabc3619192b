"""What landed responses say: probes, registrations, certificates, advisories, blocklists, screenshots.

Requests are made elsewhere; these operators take tables of responses. JSON that doesn't parse gives nulls."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.fixed_values import VISUAL_DISTANCE
from ..sources.rules import RULES, Rules
from .arrays import literal_rows

NEAR_LENGTH = 24


def _whole(text: str) -> Column:
    """A whole number as text, of any length that 64 bits hold; null for other text."""
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(text).cast("bigint"))


def misconfigurations(probes: DataFrame, scans: DataFrame | None = None, rules: Rules = RULES) -> DataFrame:
    """(scan_id, path, status, exposed, category, severity), a row for each scan and target path.

    probes: (scan_id, path, kind, ord, head_status, get_status, content_length, body_len); a path is exposed at 200, unless the
    site answers any path so, with about that length; a target without a response has status 0. scans: scan_id of those
    that were probed; without it those with any response."""
    answer = F.struct("path", "head_status", "get_status", _whole("content_length").alias("length"))
    caught = F.when((F.col("kind") == "baseline") & (F.col("get_status") == 200), F.struct("ord", "body_len"))
    per = probes.groupBy("scan_id").agg(F.min(caught).alias("catch"), F.collect_list(F.when(F.col("kind") == "target", answer)).alias("answers"))  # a scan has a response for each path
    if scans is not None:
        per = scans.select("scan_id").distinct().join(per, "scan_id", "left")
    targets = literal_rows(((p, c, s) for _, p, c, s in rules.targets), "path string, category string, severity string")
    each = per.select("scan_id", "catch", "answers", F.explode(targets).alias("rule")).withColumn("a", F.get(F.filter("answers", lambda a: a["path"] == F.col("rule.path")), F.lit(0)))
    status = F.coalesce(F.when(F.col("a.head_status").isin(405, 501), F.col("a.get_status")).otherwise(F.col("a.head_status")), F.lit(0))
    alike = F.coalesce(F.abs(F.col("a.length") - F.col("catch.body_len")) <= NEAR_LENGTH, F.lit(True))
    exposed = (status == 200) & ~(F.col("catch").isNotNull() & alike)
    return each.select("scan_id", "rule.path", status.alias("status"), exposed.alias("exposed"), "rule.category", F.when(exposed, F.col("rule.severity")).otherwise("info").alias("severity"))


def advisories(payloads: DataFrame, most: int = 10) -> DataFrame:
    """(product, ord, cve_id, severity, score, summary) of advisory responses (product, body)."""
    metric = "array<struct<baseSeverity:string,cvssData:struct<baseScore:double,baseSeverity:string>>>"
    kind = f"vulnerabilities array<struct<cve:struct<id:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:{metric},cvssMetricV30:{metric},cvssMetricV2:{metric}>>>>"
    each = payloads.select("product", F.posexplode(F.from_json("body", kind)["vulnerabilities"]).alias("ord", "v")).where("v.cve.id is not null and v.cve.id != ''")
    v3 = F.coalesce(F.get(F.col("v.cve.metrics.cvssMetricV31"), F.lit(0)), F.get(F.col("v.cve.metrics.cvssMetricV30"), F.lit(0)))
    v2 = F.get(F.col("v.cve.metrics.cvssMetricV2"), F.lit(0))
    summary = F.substring(F.get(F.filter("v.cve.descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"], 1, 400)
    severity = F.upper(F.coalesce(v3["cvssData"]["baseSeverity"], v2["baseSeverity"], F.lit("UNKNOWN")))
    return each.where(F.col("ord") < most).select("product", F.col("ord").cast("int").alias("ord"), F.col("v.cve.id").alias("cve_id"), severity.alias("severity"), F.coalesce(v3["cvssData"]["baseScore"], v2["cvssData"]["baseScore"]).alias("score"), summary.alias("summary"))


_ENTITIES = "array<struct<roles:array<string>,vcardArray:array<string>>>"


def _vcard(card: Column, field: str) -> Column:
    rows = F.from_json(F.get(card, F.lit(1)), "array<array<string>>")
    return F.get(F.get(F.filter(rows, lambda r: (F.size(r) >= 4) & (r[0] == field)), F.lit(0)), F.lit(3))


def _mail_of(entity: object) -> str | None:
    """The e-mail of an entity with the abuse role, itself first, then those within it, to any depth."""
    if not isinstance(entity, dict):
        return None
    if "abuse" in (entity.get("roles") or []):
        card = entity.get("vcardArray")
        for row in card[1] if isinstance(card, list) and len(card) > 1 and isinstance(card[1], list) else []:
            if isinstance(row, list) and len(row) >= 4 and row[0] == "email":
                return str(row[3])
    return next((m for e in entity.get("entities") or [] if (m := _mail_of(e))), None)


def _abuse_mails(bodies: pa.Array) -> pa.Array:
    """In a registrar's entities first, then anywhere."""
    out = []
    for body in bodies.to_pylist():
        try:
            said = json.loads(body or "null")
        except ValueError:
            said = None
        entities = (said.get("entities") or []) if isinstance(said, dict) else []
        registrars = [e for e in entities if isinstance(e, dict) and "registrar" in (e.get("roles") or [])]
        within = [x for e in registrars for x in e.get("entities") or []]
        out.append(next((m for e in [*within, *entities] if (m := _mail_of(e))), None))
    return pa.array(out, pa.string())


def _abuse(body: str) -> Column:
    """Entities nest to any depth, which a schema can't say."""
    return F.arrow_udf(_abuse_mails, "string")(body)


def domain_registrations(raw: DataFrame) -> DataFrame:
    """(domain, registrar, abuse_email, created, nameservers) of registration responses (key, body)."""
    r = F.from_json("body", f"events array<struct<eventAction:string,eventDate:string>>, entities {_ENTITIES}, nameservers array<struct<ldhName:string>>")
    df = raw.select(F.col("key").alias("domain"), r.alias("r"), _abuse("body").alias("abuse_email"))
    made = F.get(F.filter("r.events", lambda e: F.lower(e["eventAction"]).isin("registration", "created")), F.lit(0))["eventDate"]
    registrar = F.filter("r.entities", lambda e: F.array_contains(e["roles"], "registrar"))
    names = F.slice(F.transform(F.coalesce("r.nameservers", F.array().cast("array<struct<ldhName:string>>")), lambda n: F.lower(n["ldhName"])), 1, 6)
    name = F.get(F.filter(F.transform(registrar, lambda e: _vcard(e["vcardArray"], "fn")), lambda x: x.isNotNull()), F.lit(-1) + F.size(F.filter(F.transform(registrar, lambda e: _vcard(e["vcardArray"], "fn")), lambda x: x.isNotNull())))
    return df.select("domain", name.alias("registrar"), "abuse_email", made.alias("created"), F.concat_ws(",", names).alias("nameservers"))


def address_registrations(raw: DataFrame) -> DataFrame:
    """(address, provider, abuse_email, asn) of address responses (key, body)."""
    r = F.from_json("body", f"name string, arin_originas0_originautnumbers array<string>, originAutnums array<string>")
    numbers = F.coalesce("r.arin_originas0_originautnumbers", "r.originAutnums")
    return raw.select(F.col("key").alias("address"), r.alias("r"), _abuse("body").alias("abuse_email")).select("address", F.col("r.name").alias("provider"), "abuse_email", F.when(F.size(numbers) > 0, F.concat(F.lit("AS"), numbers[0])).alias("asn"))


def age_days(created: str, now: Column) -> Column:
    """Whole days since an ISO time or date; never negative; null for what is neither."""
    at = F.coalesce(F.try_to_timestamp(created), F.try_to_timestamp(F.substring(created, 1, 10), F.lit("yyyy-MM-dd")))
    return F.when(at.isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400))).cast("int")


def certificate_siblings(raw: DataFrame, most: int = 25) -> DataFrame:
    """(domain, ord, name): other names on a domain's certificates, in order of appearance; raw: (key, body)."""
    rows = raw.select(F.col("key").alias("domain"), F.posexplode(F.from_json("body", "array<struct<name_value:string>>")).alias("i", "c"))
    names = rows.select("domain", "i", F.posexplode(F.split("c.name_value", "\n")).alias("j", "n")).select("domain", F.lower(F.ltrim("n", F.lit("*."))).alias("name"), F.struct("i", "j").alias("at"))
    first = names.where("name != '' and not contains(name, domain)").groupBy("domain", "name").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("at", "name"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("domain", (F.col("rank") - 1).alias("ord"), "name")


def icon_hash(content: Column) -> Column:
    """The first 32 hex digits of an icon's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 32)


def feed_hits(raw: DataFrame) -> DataFrame:
    """(host, urls) of hosts that a blocklist response (key, body) lists."""
    r = F.from_json("body", "query_status string, url_count string, urls array<string>")
    df = raw.select(F.col("key").alias("host"), r.alias("r"))
    count = F.coalesce(_whole("r.url_count").cast("int"), F.size("r.urls"))
    return df.where((F.col("r.query_status") == "ok") & ((F.size("r.urls") > 0) | (F.coalesce("r.url_count", F.lit("0")) != "0"))).select("host", count.alias("urls"))


def safe_browsing(raw: DataFrame) -> DataFrame:
    r = F.from_json("body", "matches array<struct<threatType:string>>")
    kinds = F.array_sort(F.array_distinct(F.transform(F.col("r.matches"), lambda m: F.coalesce(m["threatType"], F.lit("?")))))
    return raw.select(F.col("key").alias("host"), r.alias("r")).where(F.size("r.matches") > 0).select("host", F.concat_ws(", ", kinds).alias("threats"))


def difference_hash(pixels: str) -> Column:
    """64 bits of 8 rows of 9 grey values: a bit is whether a value exceeds the one to its right, first bit highest."""
    at = "CAST(i DIV 8 * 9 + i % 8 AS INT)"
    return F.expr(f"CASE WHEN {pixels} IS NOT NULL THEN aggregate(sequence(0, 63), 0L, (h, i) -> shiftleft(h, 1) | CASE WHEN get({pixels}, {at}) > get({pixels}, {at} + 1) THEN 1L ELSE 0L END) END")


#: So many reference hashes may be broadcast and compared with each screenshot in its row.
REFERENCES = 4096


def visual_matches(shots: DataFrame, brands: DataFrame, most: int = VISUAL_DISTANCE) -> DataFrame:
    """(id, brand, distance, similarity) of shots (id, hash) and brands (brand, hash) that differ in few bits.

    Few references (counted) go to all tasks as one array that each row is filtered against. Beyond that, hashes are joined by
    quarters of 16 bits: of two hashes within `most` bits, some quarter differs in most // 4 bits at most, so a reference
    is listed under all values of a quarter that near, and a shot under its own."""
    held = brands.select("brand", "hash").distinct()
    if held.limit(REFERENCES + 1).count() <= REFERENCES:
        every = held.agg(F.collect_list(F.struct("brand", "hash")).alias("refs"))
        near = F.filter("refs", lambda r: F.bit_count(r["hash"].bitwiseXOR(F.col("hash"))) <= most)
        pairs = shots.join(F.broadcast(every)).select("id", "hash", F.explode(near).alias("r")).select("id", "r.brand", F.bit_count(F.col("hash").bitwiseXOR(F.col("r.hash"))).cast("int").alias("distance"))
    else:
        quarter = lambda h, q: F.shiftrightunsigned(h, 16 * q).bitwiseAND(F.lit(0xFFFF)).cast("int")
        masks = [0]
        for _ in range(most // 4):
            masks = sorted({m ^ (1 << b) for m in masks for b in range(16)} | set(masks))
        flips = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<int>")
        listed = held.select("brand", F.col("hash").alias("other"), F.explode(F.array(*map(F.lit, range(4)))).alias("q")).select("brand", "other", "q", F.explode(flips).alias("m"))
        listed = listed.select("brand", "other", "q", F.expr("cast((shiftrightunsigned(other, 16 * q) & 65535) as int)").bitwiseXOR(F.col("m")).alias("value"))
        own = shots.select("id", "hash", F.posexplode(F.array(*(quarter("hash", q) for q in range(4)))).alias("q", "value"))
        distance = F.bit_count(F.col("hash").bitwiseXOR(F.col("other"))).cast("int")
        pairs = own.join(listed, ["q", "value"]).select("id", "brand", distance.alias("distance")).where(F.col("distance") <= most).distinct()
    return pairs.withColumn("similarity", F.round(1 - F.col("distance") / 64, 3))


def reference_images(spark: SparkSession, folder: str) -> DataFrame:
    """(brand, content) of the PNG files of a folder, in order of name; the brand is the file's stem."""
    name = F.element_at(F.split("path", "/"), -1)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    return found.select(F.regexp_replace(name, r"\.png$", "").alias("brand"), "content").orderBy("brand")
