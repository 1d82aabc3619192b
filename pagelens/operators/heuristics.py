"""Fraud and phishing signals of captures.

Each detector is an expression that gives an array of findings (emit_ord, rule_id, category, label, evidence, severity,
weight) in a page's row; emit_ord is the order in which signals count as found, for the dedupe that keeps the first. The
expressions read the columns that prepared() adds. Rules are literal arrays in the plan: no join, no shuffle, and patterns
are compiled once. A function of the detector's name gives its findings as rows.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import authority, host_of, is_ipv4, path_of, tld
from ..sources.fixed_values import QR_CHAT_MARKS, QR_PAY_MARKS
from ..sources.rules import RULES, Rules
from .arrays import any_of, exploded, first_of_each, literal, literal_rows, matching, pattern, sql_of, where_true
from .phrases import LITERAL_RULES
from .phrases import found as phrases_found

FIELDS = ("emit_ord", "rule_id", "category", "label", "evidence", "severity", "weight")
_KINDS = ("bigint", "string", "string", "string", "string", "string", "int")
FINDING = "struct<" + ",".join(f"{f}:{k}" for f, k in zip(FIELDS, _KINDS)) + ">"
_ROW = ", ".join(f"{f} {k}" for f, k in zip(FIELDS, _KINDS))


def finding(order, rule, category, label, evidence, severity, weight) -> Column:
    values = (order, rule, category, label, evidence, severity, weight)
    return F.struct(*(x.cast(k).alias(f) if isinstance(x, Column) else F.expr(f"CAST({sql_of(x)} AS {k}) AS {f}") for f, k, x in zip(FIELDS, _KINDS, values)))


class _Tags(HTMLParser):
    """input, meta and form tags in order; an input belongs to the form that is open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.form, self.forms = [], -1, 0

    def handle_starttag(self, tag, attrs):
        if tag == "form":
            self.form, self.forms = self.forms, self.forms + 1
        if tag in ("form", "input", "meta"):
            said = {}
            for k, v in attrs:
                said.setdefault(k, v or "")
            self.found.append({"tag": tag, "form": self.form if tag != "meta" else -1, "attrs": list(said.items())})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "form":
            self.form = -1


_TAGS = pa.list_(pa.struct([("tag", pa.string()), ("form", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string()))]))


def _parse(html: pa.Array) -> pa.Array:
    out = []
    for text in html.to_pylist():
        parser = _Tags()
        try:
            parser.feed(text or "")
            parser.close()
        except AssertionError:  # how the parser rejects broken declarations: what it found so far counts
            pass
        out.append(parser.found)
    return pa.array(out, _TAGS)


def tags_of(html: str) -> Column:
    """The input, meta and form tags of a page: no built-in function parses HTML."""
    return F.arrow_udf(_parse, "array<struct<tag:string,form:int,attrs:map<string,string>>>")(html)


def prepared(caps: DataFrame) -> DataFrame:
    """Captures with low (html in lower case), host, authority and tags; what isn't used isn't computed."""
    return caps.withColumn("html", F.coalesce("html", F.lit(""))).withColumns({"low": F.lower("html"), "host": host_of(F.col("url")), "authority": authority(F.col("url")), "tags": tags_of("html")})


def _arrow_findings(rows) -> pa.Array:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = list(zip(*rows)) or [()] * len(FIELDS)
    return pa.StructArray.from_arrays([pa.array(list(c), kinds[k]) for c, k in zip(columns, _KINDS)], list(FIELDS))


def lexicon_found(rules: Rules = RULES, literal_rules: int = LITERAL_RULES) -> Column:
    if len(rules.lexicon) > literal_rules:
        made = _arrow_findings((i, r, f"scam_{c}", p, p, s, w) for i, (r, c, p, s, w) in enumerate(rules.lexicon))
        return phrases_found("low", [x[2] for x in rules.lexicon], made, FINDING)
    return F.filter(literal_rows(((i, r, f"scam_{c}", p, p, s, w) for i, (r, c, p, s, w) in enumerate(rules.lexicon)), _ROW), lambda r: F.contains(F.col("low"), r["evidence"]))


def currency_found(rules: Rules = RULES, literal_rules: int = LITERAL_RULES) -> Column:
    marks = rules.currency_markers
    some = any_of("low", marks) if len(marks) <= literal_rules else F.size(phrases_found("low", marks, pa.array(marks), "string")) > 0
    return where_true((some, finding(900, "ref.ph-currency", "ph_currency", "currency context", "₱/PHP/GCash/Maya marker", "info", 2)))


def regex_found(rules: Rules = RULES, text: str = "html") -> Column:
    """Distinct tokens of each rule, the first 200 characters of each, in order of appearance."""
    per_rule = []
    for i, (rule, category, label, severity, weight, fold, says) in enumerate(rules.regexes):
        tokens = f"array_distinct(transform(regexp_extract_all({text}, {sql_of(pattern(says, fold))}, 0), t -> substring(t, 1, 200)))"
        values = (f"{(i + 1) * 10_000} + n", sql_of(rule), sql_of(category), sql_of(label), "t", sql_of(severity), sql_of(weight))
        per_rule.append(f"transform({tokens}, (t, n) -> named_struct(" + ", ".join(f"'{f}', CAST({v} AS {k})" for f, k, v in zip(FIELDS, _KINDS, values)) + "))")
    return F.expr("flatten(array(" + ", ".join(per_rule) + "))") if per_rule else F.array().cast(f"array<{FINDING}>")


def obfuscation_found(rules: Rules = RULES) -> Column:
    return matching(((f"rlike(html, {sql_of(pattern(says, fold))})", literal(_ROW, (200_000 + i, rule, "obfuscation", label, label, "medium", 7))) for i, (rule, label, fold, says) in enumerate(rules.obfuscation)), FINDING)


def _asked(rules: Rules) -> Column:
    """What inputs show hints of, as (n, at, hint): a password type is a hint before the others."""
    attrs = F.expr("array('type', 'name', 'id', 'placeholder', 'aria-label')")
    blob = lambda t: F.lower(F.array_join(F.transform(attrs, lambda a: F.coalesce(t["attrs"][a], F.lit(""))), " "))
    inputs = F.transform(F.filter("tags", lambda t: t["tag"] == "input"), lambda t: F.struct((F.lower(F.coalesce(t["attrs"]["type"], F.lit(""))) == "password").alias("secret"), blob(t).alias("blob")))
    hints = literal_rows([(-1, "password"), *enumerate(rules.credential_hints)], "at int, hint string")
    each = lambda b, n: F.transform(F.filter(hints, lambda h: F.when(h["at"] < 0, b["secret"]).otherwise(F.contains(b["blob"], h["hint"]))), lambda h: F.struct(n.alias("n"), h["at"].alias("at"), h["hint"].alias("hint")))
    return F.flatten(F.transform(inputs, each))


def _one_asked(h: Column) -> Column:
    """The finding of a hint's first place."""
    high = h["high"] | (h["first"]["at"] == -1)
    order = F.lit(300_001) + h["first"]["n"] * 100 + h["first"]["at"]
    return finding(order, F.when(high, "ref.credential-hint-high").otherwise("ref.credential-hint"), "credential_harvest", h["hint"], h["hint"], F.when(high, "high").otherwise("medium"), F.when(h["first"]["at"] == -1, 12).when(high, 14).otherwise(8))


def with_credentials(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """df with creds: what inputs ask for, of each hint the first input that shows it."""
    hints = literal_rows(((h, h in rules.high_severity_credential_hints) for h in dict.fromkeys(("password", *rules.credential_hints))), "hint string, high boolean")
    firsts = F.transform(hints, lambda h: F.struct(h["hint"].alias("hint"), h["high"].alias("high"), F.get(F.filter("asked", lambda x: x["hint"] == h["hint"]), F.lit(0)).alias("first")))
    found = F.transform(F.filter(firsts, lambda h: h["first"].isNotNull()), _one_asked)
    return df.withColumn("asked", _asked(rules)).withColumn("creds", F.array_sort(found))


def credentials_without_parser(html: str, rules: Rules = RULES) -> Column:
    """A looser test for engines without the parser: a password input anywhere, and hints anywhere in the page."""
    low = F.lower(html)
    tests = [(F.col(html).rlike("""(?i)<input[^>]+type=["']?password"""), finding(300_000, "ref.credential-hint-high", "credential_harvest", "password", "password", "high", 12))]
    for i, h in enumerate(rules.credential_hints):
        high = h in rules.high_severity_credential_hints
        tests.append((F.contains(low, F.lit(h)), finding(300_001 + i, "ref.credential-hint-high" if high else "ref.credential-hint", "credential_harvest", h, h, "high" if high else "medium", 14 if high else 8)))
    return where_true(*tests)


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in text)


def _brands_named(rules: Rules, literal_rules: int) -> Column:
    brands = tuple(dict.fromkeys(rules.ph_brands))
    if len(brands) > literal_rules:
        return F.array_sort(phrases_found("low", brands, pa.array(brands), "string", whole_words=True))
    return F.array_sort(matching(((f"rlike(low, {sql_of(r'(?U)' + chr(92) + 'b' + _literal(b) + chr(92) + 'b')})", sql_of(b)) for b in brands), "string"))


def brand_found(rules: Rules = RULES, literal_rules: int = LITERAL_RULES) -> Column:
    """Brands named on hosts that aren't theirs; reads creds, since a page that asks for credentials weighs more."""
    host = F.col("host")
    official = F.expr(" OR ".join(f"host = {sql_of(d)} OR endswith(host, {sql_of('.' + d)})" for d in rules.brand_official_domains) or "FALSE")
    named = _brands_named(rules, literal_rules)
    active = F.size("creds") > 0
    made = F.transform(F.filter(F.array(named), lambda n: F.size(n) > 0), lambda n: finding(400_000, "ref.brand-impersonation", "brand_impersonation", F.when(active, "with credential form").otherwise("named"), F.concat(F.array_join(n, ", "), F.lit(" @ "), host), F.when(active, "high").otherwise("medium"), F.when(active, 16).otherwise(9)))
    return F.filter(made, lambda _: (host != "") & ~official)


def domain_found(rules: Rules = RULES) -> Column:
    host = F.col("host")
    ip = is_ipv4(host)
    return where_true(
        (ip, finding(410_000, "ref.raw-ip-host", "domain_reputation", "raw address", host, "low", 4)),
        (~ip & tld(host).isin(*rules.suspicious_tlds), finding(410_001, "ref.suspicious-tld", "domain_reputation", tld(host), host, "low", 5)),
    )


def anomalies_found(rules: Rules = RULES) -> Column:
    host, path = F.col("host"), F.lower(path_of(F.col("url")))
    labels = F.when(host == "", 0).otherwise(F.size(F.split(host, r"\.")))
    words = F.array_sort(F.filter(F.expr(f"CAST({sql_of(rules.phishy_path_words)} AS array<string>)"), lambda w: F.contains(path, w)))
    return where_true(
        (F.startswith(host, F.lit("xn--")) | F.contains(host, F.lit(".xn--")), finding(500_000, "ref.punycode-host", "url_anomaly", "punycode", host, "medium", 8)),
        (F.contains("authority", F.lit("@")), finding(500_001, "ref.at-in-url", "url_anomaly", "user part", F.substring("authority", 1, 80), "high", 10)),
        (labels >= 5, finding(500_002, "ref.subdomain-depth", "url_anomaly", labels, host, "low", 4)),
        (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))) >= 4, finding(500_003, "ref.hyphen-stuffing", "url_anomaly", "hyphens", host, "low", 3)),
        (F.size(words) > 0, finding(500_004, "ref.phishy-path", "url_anomaly", F.array_join(words, ", "), F.substring(path, 1, 120), "low", 4)),
    )


def with_hits(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """prepared captures with hits: all findings; of those that agree in category, label and evidence the first."""
    df = with_credentials(df, rules)
    parts = (lexicon_found(rules), currency_found(rules), regex_found(rules), obfuscation_found(rules), F.col("creds"), brand_found(rules), domain_found(rules), anomalies_found(rules))
    df = df.withColumn("found", F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull()))
    return df.withColumn("hits", first_of_each("found", lambda x: F.struct(x["category"], x["label"], x["evidence"]))).drop("found", "creds")


def qr_payloads(codes: DataFrame) -> DataFrame:
    """Findings of decoded codes (scan_id, code_type, payload)."""
    low = F.lower("payload")
    chat, pay = any_of(low, QR_CHAT_MARKS), any_of(low, QR_PAY_MARKS)
    return exploded(codes, F.array(finding(-1, "ref.payment-qr", "payment_qr", F.col("code_type"), F.substring("payload", 1, 300), F.when(chat | pay, "high").otherwise("medium"), F.when(chat, 14).when(pay, 12).otherwise(8))))


def lexicon(caps: DataFrame, rules: Rules = RULES, literal_rules: int = LITERAL_RULES) -> DataFrame:
    return exploded(prepared(caps).select("scan_id", "low"), lexicon_found(rules, literal_rules))


def currency(caps: DataFrame, rules: Rules = RULES) -> DataFrame:
    return exploded(prepared(caps), currency_found(rules))


def regex_tokens(caps: DataFrame, rules: Rules = RULES) -> DataFrame:
    return exploded(caps, regex_found(rules))


def obfuscation(caps: DataFrame, rules: Rules = RULES) -> DataFrame:
    return exploded(caps, obfuscation_found(rules))


def credentials(caps: DataFrame, rules: Rules = RULES) -> DataFrame:
    return exploded(with_credentials(prepared(caps).select("scan_id", "tags"), rules), F.col("creds"))


def brand(caps: DataFrame, rules: Rules = RULES, literal_rules: int = LITERAL_RULES) -> DataFrame:
    return exploded(with_credentials(prepared(caps), rules), brand_found(rules, literal_rules))


def domain(caps: DataFrame, rules: Rules = RULES) -> DataFrame:
    return exploded(prepared(caps), domain_found(rules))


def anomalies(caps: DataFrame, rules: Rules = RULES) -> DataFrame:
    return exploded(prepared(caps), anomalies_found(rules))


def all_heuristics(caps: DataFrame, rules: Rules = RULES) -> DataFrame:
    return exploded(with_hits(prepared(caps), rules), F.col("hits"))
