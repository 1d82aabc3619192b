"""Security posture of captures: transport, headers, cookies, mixed content, forms, leaked secrets.

Each check is an expression that gives an array of findings (category, evidence, severity, label) in a page's row; label names
the secret, and is null elsewhere. A function of the check's name gives its findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_of
from ..sources.fixed_values import CSP_WILD_SOURCE, CSRF_FIELD_HINTS, PLAIN_ASSET, SECRET_PATTERNS, SESSION_COOKIE_HINTS, VERSIONED_HEADERS
from ..sources.rules import RULES, Rules
from .arrays import any_of, exploded, literal, matching, sql_of, where_true
from .heuristics import prepared

_ROW = "category string, evidence string, severity string, label string"
MOST_SECRETS, MOST_ASSETS = 3, 5
WEAK = "struct<category:string,evidence:string,severity:string,label:string>"


def _weak(category: str, evidence, severity, label: str | None = None) -> Column:
    values = zip(("category", "evidence", "severity", "label"), (category, evidence, severity, label))
    return F.struct(*(x.cast("string").alias(f) if isinstance(x, Column) else F.expr(f"CAST({sql_of(x)} AS STRING) AS {f}") for f, x in values))


def _header(name: str) -> Column:
    return F.coalesce(F.col("headers")[name], F.lit(""))


def transport_found() -> Column:
    return where_true((F.lower("url").startswith("http://"), _weak("no_tls", F.substring("url", 1, 160), "medium")))


def missing_found(rules: Rules = RULES) -> Column:
    return matching(((f"trim(coalesce(headers[{sql_of(h)}], '')) = ''", literal(_ROW, ("missing_header", h, s, None))) for _, h, s in rules.expected_headers), WEAK)


def csp_found() -> Column:
    said = F.lower(_header("content-security-policy"))
    return where_true(
        (F.contains(said, F.lit("unsafe-inline")), _weak("csp_weak", "unsafe-inline", "low")),
        (F.contains(said, F.lit("unsafe-eval")), _weak("csp_weak", "unsafe-eval", "low")),
        (said.rlike(CSP_WILD_SOURCE), _weak("csp_weak", "* source", "medium")),
    )


def cors_found() -> Column:
    wide = F.trim(_header("access-control-allow-origin")) == "*"
    trusting = F.lower(F.trim(_header("access-control-allow-credentials"))) == "true"
    return where_true((wide & trusting, _weak("cors", "ACAO:* + ACAC:true", "high")), (wide & ~trusting, _weak("cors", "ACAO:*", "low")))


def versions_found() -> Column:
    return where_true(*((_header(h).rlike(r"(?U)\d"), _weak("info_disclosure", F.substring(F.concat(F.lit(f"{h}: "), _header(h)), 1, 160), "low")) for h in VERSIONED_HEADERS))


def cookies_found() -> Column:
    raw = _header("set-cookie")
    low = F.lower(raw)
    name = F.coalesce(F.nullif(F.substring(F.trim(F.substring_index(raw, "=", 1)), 1, 40), F.lit("")), F.lit("cookie"))
    base = F.when(any_of(low, SESSION_COOKIE_HINTS), "medium").otherwise("low")
    lacks = lambda flag: (raw != "") & ~F.contains(low, F.lit(flag))
    return where_true((lacks("httponly"), _weak("weak_cookie", name, base)), (lacks("secure"), _weak("weak_cookie", name, base)), (lacks("samesite"), _weak("weak_cookie", name, "info")))


def mixed_found() -> Column:
    """The first of the plain assets in order of their URL."""
    dom = F.regexp_extract_all("html", F.lit(PLAIN_ASSET), 1)
    net = F.filter(F.transform("requests", lambda r: F.when(F.contains(r, F.lit(" ")), F.regexp_replace(r, r"^[^ ]* ", "")).otherwise(r)), lambda u: F.lower(u).startswith("http://"))
    assets = F.slice(F.array_sort(F.array_union(dom, net)), 1, MOST_ASSETS)
    return F.filter(F.transform(assets, lambda a: _weak("mixed_content", F.substring(a, 1, 160), "low")), lambda _: F.lower("url").startswith("https://"))


def _one_form(form: Column) -> Column:
    inputs = F.filter("tags", lambda t: (t["tag"] == "input") & (t["form"] == form["form"]))
    said = lambda t, a: F.lower(F.coalesce(t["attrs"][a], F.lit("")))
    action = F.trim(F.coalesce(form["attrs"]["action"], F.lit("")))
    low, there = F.lower(action), host_of(action)
    plain = low.startswith("http://")
    found = where_true(
        (plain, _weak("insecure_form", F.substring(action, 1, 160), "high")),
        (~plain & low.startswith("http") & (there != F.col("host")), _weak("insecure_form", F.concat("host", F.lit(" -> "), there), "medium")),
        (~any_of(F.array_join(F.transform(inputs, lambda t: said(t, "name")), " "), CSRF_FIELD_HINTS), _weak("insecure_form", "no csrf token", "low")),
    )
    return F.filter(found, lambda _: F.exists(inputs, lambda t: said(t, "type") == "password"))


def forms_found() -> Column:
    """Forms with a password field: plain or foreign target, no token against forged requests."""
    return F.flatten(F.transform(F.filter("tags", lambda t: t["tag"] == "form"), _one_form))


#: SQL of what is shown of a token t.
_REDACTED = "CASE WHEN length(trim(t)) <= 12 THEN concat(substring(trim(t), 1, 4), '…') ELSE concat(substring(trim(t), 1, 8), '…', right(trim(t), 4), ' (len ', length(trim(t)), ')') END"


def secrets_found() -> Column:
    """Distinct tokens in html and requests, the first of each kind; reads hay."""
    each = []
    for label, severity, says, hide in SECRET_PATTERNS:
        tokens = f"slice(array_distinct(filter(regexp_extract_all(hay, {sql_of(says)}, 0), t -> t != '')), 1, {MOST_SECRETS})"
        each.append(f"transform({tokens}, t -> named_struct('category', 'sensitive_exposure', 'evidence', {_REDACTED if hide else sql_of(label)}, 'severity', {sql_of(severity)}, 'label', {sql_of(label)}))")
    return F.expr(f"flatten(array({', '.join(each)}))")


def with_hay(df: DataFrame) -> DataFrame:
    return df.withColumn("hay", F.concat_ws("\n", "html", F.array_join("requests", "\n")))


def with_weaknesses(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """prepared captures with weak (posture) and leaks (secrets)."""
    parts = (transport_found(), missing_found(rules), csp_found(), cors_found(), versions_found(), cookies_found(), mixed_found(), forms_found())
    return with_hay(df).withColumns({"weak": F.flatten(F.array(*parts)), "leaks": secrets_found()}).drop("hay")


def _rows(found):
    def run(caps: DataFrame, *rules: Rules) -> DataFrame:
        return exploded(with_hay(prepared(caps)), found(*rules))

    return run


transport, missing_headers, csp, cors = map(_rows, (transport_found, missing_found, csp_found, cors_found))
versions, cookies, mixed_content, forms, secrets = map(_rows, (versions_found, cookies_found, mixed_found, forms_found, secrets_found))
