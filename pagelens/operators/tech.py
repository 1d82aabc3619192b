"""Software fingerprints of captures, and the known vulnerabilities of what they name; as arrays in a page's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.fixed_values import KNOWN_VULNERABILITIES
from ..sources.rules import RULES, Rules
from .arrays import exploded, first_of_each, listed, literal, literal_rows, matching, pattern, sql_of
from .heuristics import prepared

#: A product with a version; a product alone.
VERSIONED = r"([A-Za-z][A-Za-z0-9_\-]+)[/ ]v?(\d+(?:\.\d+){0,3})"
_ALONE = r"(?U)^[A-Za-z][\w\-.]*$"
PRINT = "struct<emit_ord:bigint,product:string,version:string,source:string,rule_id:string>"
_ROW = "emit_ord bigint, product string, version string, source string, rule_id string"
_CVE = ("scan_id", "cve_id", "kind", "severity", "score", "matched_product")


def _print(order: str, product: str, version: str, source: str, rule: str) -> str:
    """SQL of a fingerprint; order, product and version are SQL."""
    return f"named_struct('emit_ord', CAST({order} AS BIGINT), 'product', CAST({product} AS STRING), 'version', CAST({version} AS STRING), 'source', {sql_of(source)}, 'rule_id', {sql_of(rule)})"


def _tokens(value: str, order: str, source: str, rule: str) -> tuple[str, str]:
    """SQL of (products with versions in a value, its first token as an array if that looks like a product)."""
    part = lambda g: f"regexp_extract_all({value}, {sql_of(VERSIONED)}, {g})"
    found = f"transform(arrays_zip({part(1)}, {part(2)}), (x, i) -> {_print(f'{order} + i', 'x.`0`', 'x.`1`', source, rule)})"
    alone = f"trim(substring_index(substring_index({value}, ';', 1), ',', 1))"
    return found, f"filter(array({_print(order, alone, 'NULL', source, rule)}), x -> rlike(x.product, {sql_of(_ALONE)}))"


def _header(i: int, header: str, rule: str) -> Column:
    found, single = _tokens(f"coalesce(headers[{sql_of(header)}], '')", str(1000 * i), f"header:{header}", rule)
    return F.expr(f"CASE WHEN size({found}) > 0 THEN {found} ELSE {single} END")


def _metas() -> Column:
    """Of generators and application names: products with versions, else one token, else the first 60 characters."""
    said, rule = "trim(coalesce(t.attrs['content'], ''))", ("meta:generator", "tech.meta-generator")
    found, single = _tokens(said, "200000 + n * 100", *rule)
    whole = f"array({_print('200000 + n * 100', f'substring({said}, 1, 60)', 'NULL', *rule)})"
    one = f"CASE WHEN {said} = '' THEN slice({whole}, 1, 0) WHEN size({found}) > 0 THEN {found} WHEN size({single}) > 0 THEN {single} ELSE {whole} END"
    return F.expr(f"flatten(transform(filter(tags, t -> t.tag = 'meta' AND lower(coalesce(t.attrs['name'], t.attrs['property'], '')) IN ('generator', 'application-name')), (t, n) -> {one}))")


def with_prints(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """prepared captures with prints: (emit_ord, product, version, source, rule_id), the first of each product and version."""
    parts = [_header(i, header, rule) for i, (rule, header) in enumerate(rules.revealing_headers)]
    parts.append(matching(((f"contains(lower(coalesce(headers['set-cookie'], '')), {sql_of(part.lower())})", literal(_ROW, (100_000 + i, product, None, f"cookie:{part}", rule))) for i, (rule, part, product) in enumerate(rules.cookies)), PRINT))
    parts.append(_metas())
    parts.append(matching(((f"rlike(html, {sql_of(pattern(says, fold))})", literal(_ROW, (300_000 + i, product, None, "dom:path", rule))) for i, (rule, product, says, fold) in enumerate(rules.dom)), PRINT))
    for k, (rule, names, says, fold) in enumerate(rules.js_libraries):
        part = lambda g: f"regexp_extract_all(html, {sql_of(pattern(says, fold))}, {g})"  # noqa: E731, B023
        known = f"coalesce(get(filter(CAST({sql_of(tuple(names))} AS array<string>), n -> startswith(n, lower(x.`0`))), 0), lower(x.`0`))"
        parts.append(F.expr(f"transform(arrays_zip({part(1)}, {part(2)}), (x, i) -> {_print(f'{400_000 + k * 10_000} + i', known, 'x.`1`', 'dom:asset', rule)})"))
    df = df.withColumn("found", F.flatten(listed(parts, f"array<{PRINT}>")))
    return df.withColumn("prints", first_of_each("found", lambda x: F.struct(F.lower(x["product"]).alias("p"), F.coalesce(x["version"], F.lit("")).alias("v")))).drop("found")


def with_vulnerabilities(df: DataFrame) -> DataFrame:
    """df with cves: (at, cve_id, kind, severity, score, matched_product) of prints with versions, by part of the product's name
    and prefix of the version's text; the first of each cve_id. at: (place of the print, place of the entry)."""
    entries = literal_rows(((i, p, vs, c, k, s, float(x)) for i, (p, vs, c, k, s, x) in enumerate(KNOWN_VULNERABILITIES)), "i int, part string, prefixes array<string>, cve_id string, kind string, severity string, score double")
    versioned = F.filter("prints", lambda p: F.coalesce(p["version"], F.lit("")) != "")

    def of_print(p: Column) -> Column:
        fits = F.filter(entries, lambda r: F.contains(F.lower(p["product"]), r["part"]) & F.exists(r["prefixes"], lambda x: F.startswith(p["version"], x)))
        return F.transform(fits, lambda r: F.struct(F.struct(p["emit_ord"].alias("p"), r["i"].alias("i")).alias("at"), *(r[c].alias(c) for c in ("cve_id", "kind", "severity", "score")), F.concat_ws(" ", p["product"], p["version"]).alias("matched_product")))

    return df.withColumn("named", F.flatten(F.transform(versioned, of_print))).withColumn("cves", first_of_each("named", lambda x: x["cve_id"])).drop("named")


def with_advisories(df: DataFrame, records: DataFrame) -> DataFrame:
    """df with the advisory records (product, ord, cve_id, severity, score) of products with versions added to cves; product is
    the term that was looked up, the product's name and version. Of the same cve_id known ones stay, else the first."""
    terms = df.select("scan_id", F.explode(F.filter("prints", lambda p: F.coalesce(p["version"], F.lit("")) != "")).alias("p"))
    terms = terms.select("scan_id", F.col("p.emit_ord").alias("emit_ord"), F.concat_ws(" ", "p.product", "p.version").alias("matched_product"))
    records = records.select(F.lower("product").alias("term"), "ord", "cve_id", "severity", "score")
    found = terms.join(records, F.lower("matched_product") == F.col("term"))
    one = F.struct(F.struct(F.col("emit_ord").alias("p"), F.col("ord").cast("int").alias("i")).alias("at"), "cve_id", F.lit("cve").alias("kind"), "severity", "score", "matched_product")
    more = found.groupBy("scan_id").agg(F.array_sort(F.collect_list(one)).alias("more"))
    both = df.join(more, "scan_id", "left").withColumn("named", F.concat("cves", F.coalesce("more", F.slice("cves", 1, 0))))
    return both.withColumn("cves", first_of_each("named", lambda x: x["cve_id"])).drop("named", "more")


def vulnerability_rows(entries=KNOWN_VULNERABILITIES) -> str:
    """SQL of a table of entries as vulnerabilities_by_table takes it."""
    rows = ", ".join("(" + ", ".join((str(i), sql_of(p), sql_of(tuple(vs)), sql_of(c), sql_of(k), sql_of(s), f"CAST({x} AS DOUBLE)")) + ")" for i, (p, vs, c, k, s, x) in enumerate(entries))
    return f"SELECT * FROM VALUES {rows} AS known(i, part, prefixes, cve_id, kind, severity, score)"


def vulnerabilities_by_table(prints: DataFrame, known: DataFrame) -> DataFrame:
    """(scan_id, cves) of prints (scan_id, emit_ord, product, version) by a table of any size: known (i, part, prefixes, cve_id,
    kind, severity, score). The same as with_vulnerabilities gives, by equality instead of a test of each entry.

    Of each distinct product and version all substrings as long as some part, and all beginnings of the version as long as
    some prefix, are joined to the entries' own. What a product and version has is put together before it goes to the scans."""
    sizes = known.select(F.length("part").alias("n"), F.explode("prefixes").alias("prefix")).agg(F.collect_set("n").alias("parts"), F.collect_set(F.length("prefix")).alias("prefixes")).first()  # as many as there are lengths
    named = prints.where("coalesce(version, '') != ''").select("scan_id", "emit_ord", "product", "version", F.lower("product").alias("low"))
    lengths = lambda of: F.expr(f"CAST({sql_of(tuple(sorted(of)))} AS array<int>)")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), lambda i: F.substring(F.col("low"), i, n))
    parts = F.flatten(F.transform(F.filter(lengths(sizes.parts), lambda n: n <= F.length("low")), cut))
    begins = F.transform(F.filter(lengths(sizes.prefixes), lambda n: n <= F.length("version")), lambda n: F.substring(F.col("version"), F.lit(1), n))
    asked = named.select("low", "version").distinct().select("low", "version", F.explode(F.array_distinct(parts)).alias("part"), F.array_distinct(begins).alias("begins"))
    asked = asked.select("low", "version", "part", F.explode("begins").alias("prefix"))
    entry = F.struct(*(F.col(c) for c in ("i", "cve_id", "kind", "severity", "score")))
    fits = asked.join(known.select("part", F.explode(F.array_distinct("prefixes")).alias("prefix"), entry.alias("entry")), ["part", "prefix"])
    fits = fits.groupBy("low", "version").agg(F.array_sort(F.collect_set("entry")).alias("entries"))  # what one version of one product has
    one = lambda e: F.struct(F.struct(F.col("emit_ord").alias("p"), e["i"].cast("int").alias("i")).alias("at"), *(e[c].alias(c) for c in ("cve_id", "kind", "severity", "score")), F.concat_ws(" ", "product", "version").alias("matched_product"))
    each = named.join(fits, ["low", "version"]).select("scan_id", F.transform("entries", one).alias("named"))
    scans = each.groupBy("scan_id").agg(F.array_sort(F.flatten(F.collect_list("named"))).alias("named"))
    return scans.select("scan_id", first_of_each("named", lambda x: x["cve_id"]).alias("cves"))


def with_vulnerability_table(df: DataFrame, known: DataFrame) -> DataFrame:
    """df (scan_id, prints) with cves by a table instead of the rules' own list."""
    prints = df.select("scan_id", F.explode("prints").alias("p")).select("scan_id", "p.emit_ord", "p.product", "p.version")
    found = vulnerabilities_by_table(prints, known)
    none = F.array().cast(found.schema["cves"].dataType)
    return df.drop("cves").join(found, "scan_id", "left").withColumn("cves", F.coalesce("cves", none))


def fingerprints(caps: DataFrame, rules: Rules = RULES) -> DataFrame:
    return exploded(with_prints(prepared(caps), rules), F.col("prints"))


def known_vulnerabilities(caps: DataFrame, rules: Rules = RULES) -> DataFrame:
    return exploded(with_vulnerabilities(with_prints(prepared(caps), rules)), F.col("cves")).select(*_CVE)


def log_line(prints: str) -> Column:
    """The products found, as one line for a log."""
    said = F.array_join(F.transform(prints, lambda p: F.concat_ws("/", p["product"], p["version"])), ", ")
    return F.when(said == "", "none identified").otherwise(said)
