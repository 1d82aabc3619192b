"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import urls
from .operators import heuristics as H
from .operators import images as I
from .operators import landed as N
from .operators import posture as P
from .operators import tech as T
from .operators.arrays import exploded
from .operators.entities import abuse_contacts
from .plans import history as D
from .plans import reports as X
from .plans import risk as R
from .plans import scan as S
from .plans.asof import as_of
from .sources import fixed_values as V
from .sources import responses as L
from .sources.captures import capture_stream, captures, captures_sql, quoted, screenshots, values
from .sources.shared import fresh_dir, written
from .streaming.cases import store_scans, stored

QUERIES: dict = {}
ORACLES: dict = {}
_CAP = captures_sql()


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def on_captures(sql: str | None = None):
    """A query over captures; {CAP} stands before the SQL's own tables."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(captures(spark, sf_dir))

        run.of = f
        return query(f"{_CAP} {sql}" if sql else None, f.__name__)(run)

    return add


def re2(text: str) -> str:
    """A pattern for SQL's engine, which has no look-ahead: the one there is only repeats what must follow anyway."""
    return text.replace("p(?=\\d)", "p")


# ---- urls

_REG = f"""CASE WHEN regexp_matches(replace(host, '.', ''), '^[0-9]+$') THEN host
  WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({", ".join(map(quoted, V.TWO_LABEL_SUFFIXES))}) THEN array_to_string(string_split(host, '.')[-3:], '.')
  ELSE array_to_string(string_split(host, '.')[-2:], '.') END"""


@on_captures(f"""SELECT scan_id, host, path, {_REG} AS registrable, CASE WHEN contains(host, '.') THEN '.' || string_split(host, '.')[-1] ELSE '' END AS tld,
  regexp_matches(host, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') AS is_ip, left(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 120) AS slug,
  regexp_extract(url, '^[a-z]+://') || authority || '/' AS origin FROM cap""")
def url_parts(caps):
    host = urls.host_of(F.col("url"))
    url = F.col("url")
    return caps.select("scan_id", host.alias("host"), urls.path_of(url).alias("path"), urls.registrable(host).alias("registrable"), urls.tld(host).alias("tld"), urls.is_ipv4(host).alias("is_ip"), urls.slug(url, 120, "target").alias("slug"), urls.origin(url).alias("origin"))


# ---- fraud signals

_LEX = values((r, f"scam_{c}", p, s, w) for r, c, p, s, w in V.LEXICON) + " l(rule_id, category, phrase, severity, weight)"
_LEX_SQL = f"SELECT scan_id, rule_id, category, phrase AS evidence, severity, CAST(weight AS INTEGER) AS weight FROM cap JOIN {_LEX} ON contains(lower(html), phrase)"
_SHOWN = ("scan_id", "rule_id", "category", "evidence", "severity", "weight")


@on_captures(_LEX_SQL)
def lexicon_hits(caps):
    return H.lexicon(caps).select(*_SHOWN)


@on_captures(_LEX_SQL)
def lexicon_automaton(caps):
    """lexicon_hits as rule sets of any size are matched."""
    return H.lexicon(caps, literal_rules=0).select(*_SHOWN)


@on_captures(f"SELECT category, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT scan_id) AS BIGINT) AS pages FROM ({_LEX_SQL}) GROUP BY category")
def lexicon_category_counts(caps):
    return H.lexicon(caps).groupBy("category").agg(F.count("*").alias("hits"), F.countDistinct("scan_id").alias("pages"))


_CUR = " OR ".join(f"contains(lower(html), {quoted(m)})" for m in V.CURRENCY_MARKERS)


@on_captures(f"SELECT scan_id, CAST(2 AS INTEGER) AS weight FROM cap WHERE {_CUR}")
def currency_context(caps):
    return H.currency(caps).select("scan_id", "weight")


_RX = " UNION ALL ".join(f"SELECT DISTINCT scan_id, {quoted(r)} AS rule_id, {quoted(c)} AS category, left(t, 200) AS evidence, {quoted(s)} AS severity, CAST({w} AS INTEGER) AS weight FROM (SELECT scan_id, unnest(regexp_extract_all(html, {quoted(('(?i)' if fold else '') + re2(p))})) AS t FROM cap)" for r, c, _, s, w, fold, p in V.REGEX_DETECTORS)


@on_captures(_RX)
def regex_detector_hits(caps):
    return H.regex_tokens(caps).select(*_SHOWN)


_MOBILE = next(r for r in V.REGEX_DETECTORS if r[1] == "ph_mobile")


_NUMBER = "text || CASE WHEN doc_id % 40 = 0 THEN ' call +63917' || CAST(1000000 + doc_id AS STRING) || ' or 0917 123 4567' ELSE '' END"


@query(f"SELECT DISTINCT doc_id, t AS token FROM (SELECT doc_id, unnest(regexp_extract_all({_NUMBER}, {quoted(_MOBILE[-1])})) AS t FROM documents)")
def documents_ph_mobile(spark, sf_dir):
    """Phone numbers in documents, which hold none of their own: each fortieth gets some."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(_NUMBER).alias("text"))
    return docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(H.pattern(_MOBILE[-1], False)), 0))).alias("token"))


_OBF = " UNION ALL ".join(f"SELECT scan_id, {quoted(r)} AS rule_id, {quoted(lb)} AS evidence FROM cap WHERE regexp_matches(html, {quoted(('(?i)' if fold else '') + p)})" for r, lb, fold, p in V.OBFUSCATION)


@on_captures(_OBF)
def obfuscation_hits(caps):
    return H.obfuscation(caps).select("scan_id", "rule_id", "evidence")


_ATTRS = ("type", "name", "id", "placeholder", "aria-label")
_BLOB = " || ' ' || ".join(f"coalesce(nullif(regexp_extract(tag, {quoted(f'(?i) {a}=[' + chr(34) + chr(39) + ']([^' + chr(34) + chr(39) + ']*)')}, 1), ''), '')" for a in _ATTRS)
_HINTS = values([(-1, "password-type")] + list(enumerate(V.CREDENTIAL_HINTS))) + " k(pos, hint)"
_HIGH = ", ".join(map(quoted, V.HIGH_SEVERITY_CREDENTIAL_HINTS))
_CRED = f"""i AS (SELECT scan_id, generate_subscripts(regexp_extract_all(html, '(?i)<input[^>]*>'), 1) AS n, unnest(regexp_extract_all(html, '(?i)<input[^>]*>')) AS tag FROM cap),
b AS (SELECT scan_id, n, lower({_BLOB}) AS blob, lower(regexp_extract(tag, '(?i) type=[\x22\x27\x27]([^\x22\x27\x27]*)', 1)) = 'password' AS secret FROM i),
c AS (SELECT scan_id, CASE WHEN pos = -1 THEN 'password' ELSE hint END AS hint, pos, n FROM b JOIN {_HINTS} ON CASE WHEN pos = -1 THEN secret ELSE contains(blob, hint) END),
d AS (SELECT *, row_number() OVER (PARTITION BY scan_id, hint ORDER BY n, pos) AS r FROM c),
cred AS (SELECT scan_id, hint AS evidence, CASE WHEN pos = -1 OR hint IN ({_HIGH}) THEN 'high' ELSE 'medium' END AS severity,
  CAST(CASE WHEN pos = -1 THEN 12 WHEN hint IN ({_HIGH}) THEN 14 ELSE 8 END AS INTEGER) AS weight FROM d WHERE r = 1)"""


@on_captures(f", {_CRED} SELECT * FROM cred")
def credential_fields(caps):
    return H.credentials(caps).select("scan_id", "evidence", "severity", "weight")


_OFFICIAL = " OR ".join(f"host = {quoted(d)} OR ends_with(host, {quoted('.' + d)})" for d in V.BRAND_OFFICIAL_DOMAINS)
_NAMED = "list_sort(list_distinct([x for x in [" + ", ".join(f"CASE WHEN regexp_matches(lower(html), {quoted(chr(92) + 'b' + H._literal(b) + chr(92) + 'b')}) THEN {quoted(b)} END" for b in V.PH_BRANDS) + "] if x IS NOT NULL]))"
_BRAND = f""", {_CRED}, n AS (SELECT scan_id, host, {_NAMED} AS named, scan_id IN (SELECT scan_id FROM cred) AS form FROM cap WHERE host <> '' AND NOT ({_OFFICIAL})),
brand AS (SELECT scan_id, array_to_string(named, ', ') || ' @ ' || host AS evidence, CAST(CASE WHEN form THEN 16 ELSE 9 END AS INTEGER) AS weight FROM n WHERE len(named) > 0)"""


@on_captures(f"{_BRAND} SELECT * FROM brand")
def brand_impersonation(caps):
    return H.brand(caps).select("scan_id", "evidence", "weight")


@on_captures(f"{_BRAND} SELECT * FROM brand")
def brand_automaton(caps):
    """brand_impersonation as brand lists of any size are matched."""
    return H.brand(caps, literal_rules=0).select("scan_id", "evidence", "weight")


_TLDS = ", ".join(map(quoted, V.SUSPICIOUS_TLDS))
_DOM = f"""SELECT scan_id, CASE WHEN regexp_matches(host, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') THEN 'ref.raw-ip-host' ELSE 'ref.suspicious-tld' END AS rule_id, host AS evidence,
  CAST(CASE WHEN regexp_matches(host, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') THEN 4 ELSE 5 END AS INTEGER) AS weight FROM cap
  WHERE regexp_matches(host, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') OR (contains(host, '.') AND '.' || string_split(host, '.')[-1] IN ({_TLDS}))"""


@on_captures(_DOM)
def domain_reputation(caps):
    return H.domain(caps).select("scan_id", "rule_id", "evidence", "weight")


_WORDS = "[" + ", ".join(map(quoted, sorted(V.PHISHY_PATH_WORDS))) + "]"
_ANOM = f"""SELECT scan_id, 'ref.punycode-host' AS rule_id, host AS evidence, CAST(8 AS INTEGER) AS weight FROM cap WHERE starts_with(host, 'xn--') OR contains(host, '.xn--')
UNION ALL SELECT scan_id, 'ref.at-in-url', left(authority, 80), 10 FROM cap WHERE contains(authority, '@')
UNION ALL SELECT scan_id, 'ref.subdomain-depth', host, 4 FROM cap WHERE len(string_split(host, '.')) >= 5
UNION ALL SELECT scan_id, 'ref.hyphen-stuffing', host, 3 FROM cap WHERE len(host) - len(replace(host, '-', '')) >= 4
UNION ALL SELECT scan_id, 'ref.phishy-path', left(lower(path), 120), 4 FROM cap WHERE len([w for w in {_WORDS} if contains(lower(path), w)]) > 0"""


@on_captures(_ANOM)
def url_anomalies(caps):
    return H.anomalies(caps).select("scan_id", "rule_id", "evidence", "weight")


_QR = "CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 'https://T.me/pay' WHEN 1 THEN 'gcash:0917?amount=' || CAST(page_id AS STRING) WHEN 2 THEN '4006381333931' WHEN 3 THEN 'bc1qxyz' WHEN 4 THEN 'whatsapp gcash' ELSE url END"
_HAS = lambda marks: "(" + " OR ".join(f"contains(lower(payload), {quoted(m)})" for m in marks) + ")"
_QR_SQL = f"SELECT page_id AS scan_id, left(payload, 300) AS evidence, CAST(CASE WHEN {_HAS(V.QR_CHAT_MARKS)} THEN 14 WHEN {_HAS(V.QR_PAY_MARKS)} THEN 12 ELSE 8 END AS INTEGER) AS weight FROM (SELECT page_id, {_QR} AS payload FROM pages)"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic decoded codes of pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.col("page_id").alias("scan_id"), F.lit("QRCODE").alias("code_type"), F.expr(_QR).alias("payload"))


@query(_QR_SQL)
def qr_payload_scoring(spark, sf_dir):
    return H.qr_payloads(codes(spark, sf_dir)).select("scan_id", "evidence", "weight")


@query("SELECT page_id AS scan_id, 'QRCODE' AS code_type, url AS payload FROM pages WHERE length(url) > 0")
def qr_decoded(spark, sf_dir):
    """Codes read back from synthetic screenshots of all pages."""
    return I.decoded(screenshots(spark.read.parquet(f"{sf_dir}/pages.parquet")))


@query(f"SELECT scan_id, left(payload, 300) AS evidence, CAST(CASE WHEN {_HAS(V.QR_CHAT_MARKS)} THEN 14 WHEN {_HAS(V.QR_PAY_MARKS)} THEN 12 ELSE 8 END AS INTEGER) AS weight FROM (SELECT page_id AS scan_id, url AS payload FROM pages WHERE length(url) > 0)")
def qr_screens_scoring(spark, sf_dir):
    """Findings of the codes in all screenshots."""
    return H.qr_payloads(qr_decoded(spark, sf_dir)).select("scan_id", "evidence", "weight")


_ALL_HITS = f"""hits AS (
  SELECT scan_id, rule_id, evidence, weight FROM ({_LEX_SQL}) UNION ALL SELECT scan_id, 'ref.ph-currency', '₱/PHP/GCash/Maya marker', 2 FROM cap WHERE {_CUR}
  UNION ALL SELECT scan_id, rule_id, evidence, weight FROM ({_RX}) UNION ALL SELECT scan_id, rule_id, evidence, 7 FROM ({_OBF})
  UNION ALL SELECT scan_id, CASE severity WHEN 'high' THEN 'ref.credential-hint-high' ELSE 'ref.credential-hint' END, evidence, weight FROM cred
  UNION ALL SELECT scan_id, 'ref.brand-impersonation', evidence, weight FROM brand UNION ALL {_DOM} UNION ALL {_ANOM})"""


@on_captures(f"{_BRAND}, {_ALL_HITS} SELECT * FROM hits")
def heuristics_all(caps):
    return H.all_heuristics(caps).select("scan_id", "rule_id", "evidence", "weight")


@on_captures(f"{_BRAND}, {_ALL_HITS} SELECT rule_id, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT scan_id) AS BIGINT) AS pages FROM hits GROUP BY rule_id")
def rule_effectiveness(caps):
    return H.all_heuristics(caps).groupBy("rule_id").agg(F.count("*").alias("hits"), F.countDistinct("scan_id").alias("pages"))


_DAY = "DATE '2026-06-20' + CAST(cap.scan_id % 7 AS INTEGER)"
_SUFFIX = "CASE WHEN contains(host, '.') THEN '.' || string_split(host, '.')[-1] ELSE '' END"


@on_captures(f"""{_BRAND}, {_ALL_HITS}, f AS (SELECT rule_id, {_SUFFIX} AS suffix, {_DAY} AS day FROM hits JOIN cap ON cap.scan_id = hits.scan_id)
SELECT rule_id, suffix, day, CAST(grouping_id(rule_id, suffix, day) AS INTEGER) AS grouping, CAST(count(*) AS BIGINT) AS findings FROM f GROUP BY GROUPING SETS ((rule_id), (suffix), (day), (suffix, day), ())""")
def findings_by_sets(caps):
    """Findings by rule, by suffix of the host, by day, by both and altogether, in one aggregation; days are made up."""
    found = H.with_hits(H.prepared(caps)).select(urls.tld(F.col("host")).alias("suffix"), F.expr("date_add(DATE '2026-06-20', CAST(scan_id % 7 AS INT))").alias("day"), F.explode_outer("hits.rule_id").alias("rule_id")).where("rule_id is not null")
    sets = found.groupingSets([["rule_id"], ["suffix"], ["day"], ["suffix", "day"], []], "rule_id", "suffix", "day")
    return sets.agg(F.grouping_id("rule_id", "suffix", "day").cast("int").alias("grouping"), F.count("*").alias("findings"))


# ---- software

_PAIR = "([A-Za-z][A-Za-z0-9_-]+)[/ ]v?([0-9]+(?:[.][0-9]+){0,3})"


_REVEALING = values((i, r, h) for i, (r, h) in enumerate(V.REVEALING_HEADERS)) + " rh(i, rule, header)"
_COOK = values((i, *x) for i, x in enumerate(V.COOKIE_SIGNATURES)) + " c(i, rule_id, part, product)"
_DOM_SIG = " UNION ALL ".join(f"SELECT scan_id, {300_000 + i} AS o, {quoted(p)} AS product, NULL AS version, 'dom:path' AS source, {quoted(r)} AS rule_id FROM cap WHERE regexp_matches(html, {quoted('(?i)' + says)})" for i, (r, p, says) in enumerate(V.DOM_SIGNATURES))
_JS = quoted("(?i)" + V.JS_LIBRARIES[2])
_ATTR = lambda name: f"coalesce(nullif(regexp_extract(tag, {quoted('(?i) ' + name + '=[' + chr(34) + chr(39) + ']([^' + chr(34) + chr(39) + ']*)')}, 1), ''), '')"
_SINGLE = lambda v: f"trim(split_part(split_part({v}, ';', 1), ',', 1))"
_IS_TOKEN = r"'^[A-Za-z][\w\-.]*$'"
#: SQL of all fingerprints, first of each product and version, and of vulnerabilities by the curated list.
_PRINTS = f"""hv AS (SELECT scan_id, i * 1000 AS o, value, 'header:' || header AS source, rule FROM hdr JOIN {_REVEALING} ON header = name WHERE value <> ''),
mt AS (SELECT scan_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS tag FROM (SELECT scan_id, regexp_extract_all(html, '(?i)<meta[^>]*>') AS l FROM cap)),
mv AS (SELECT scan_id, 200000 + n * 100 AS o, trim({_ATTR('content')}) AS value, 'meta:generator' AS source, 'tech.meta-generator' AS rule FROM mt WHERE lower(coalesce(nullif({_ATTR('name')}, ''), {_ATTR('property')})) IN ('generator', 'application-name')),
vv AS (SELECT * FROM hv UNION ALL SELECT * FROM mv WHERE value <> ''),
vp AS (SELECT *, regexp_extract_all(value, '{_PAIR}', 1) AS ps, regexp_extract_all(value, '{_PAIR}', 2) AS vs FROM vv),
pr AS (SELECT scan_id, o + generate_subscripts(ps, 1) - 1 AS o, unnest(ps) AS product, unnest(vs) AS version, source, rule AS rule_id FROM vp
  UNION ALL SELECT scan_id, o, {_SINGLE('value')}, NULL, source, rule FROM vp WHERE len(ps) = 0 AND regexp_matches({_SINGLE('value')}, {_IS_TOKEN})
  UNION ALL SELECT scan_id, o, left(value, 60), NULL, source, rule FROM vp WHERE len(ps) = 0 AND source = 'meta:generator' AND NOT regexp_matches({_SINGLE('value')}, {_IS_TOKEN})
  UNION ALL SELECT scan_id, 100000 + i, product, NULL, 'cookie:' || part, rule_id FROM hdr JOIN {_COOK} ON hdr.name = 'set-cookie' AND contains(lower(hdr.value), lower(part))
  UNION ALL {_DOM_SIG}
  UNION ALL SELECT scan_id, 399999 + generate_subscripts(ps, 1), lower(unnest(ps)), unnest(vs), 'dom:asset', {quoted(V.JS_LIBRARIES[0])} FROM (SELECT scan_id, regexp_extract_all(html, {_JS}, 1) AS ps, regexp_extract_all(html, {_JS}, 2) AS vs FROM cap)),
prints AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY scan_id, lower(product), coalesce(version, '') ORDER BY o) = 1)"""
_KB = values((i, p, v, c, k, s, float(x)) for i, (p, vs, c, k, s, x) in enumerate(V.KNOWN_VULNERABILITIES) for v in vs) + " kb(pos, part, prefix, cve_id, kind, severity, score)"
_CVES = f"""cves AS (SELECT scan_id, cve_id, kind, severity, CAST(score AS DOUBLE) AS score, product || ' ' || version AS matched_product FROM prints JOIN {_KB} ON contains(lower(product), part) AND starts_with(version, prefix)
  QUALIFY row_number() OVER (PARTITION BY scan_id, cve_id ORDER BY o, pos) = 1)"""


@on_captures(f", {_PRINTS} SELECT scan_id, product, version, source, rule_id FROM prints")
def tech_stack(caps):
    return T.fingerprints(caps).select("scan_id", "product", "version", "source", "rule_id")


@on_captures(f", {_PRINTS} SELECT scan_id, split_part(source, ':', 2) AS header, product, version FROM prints WHERE starts_with(source, 'header:') AND version IS NOT NULL")
def tech_headers(caps):
    prints = T.fingerprints(caps).where("startswith(source, 'header:') and version is not null")
    return prints.select("scan_id", F.substring_index("source", ":", -1).alias("header"), "product", "version")


@on_captures(f"SELECT DISTINCT scan_id, product FROM hdr JOIN {_COOK} ON hdr.name = 'set-cookie' AND contains(lower(hdr.value), lower(part))")
def tech_cookies(caps):
    return T.fingerprints(caps).where("startswith(source, 'cookie:')").select("scan_id", "product")


@on_captures(f", {_PRINTS} SELECT scan_id, string_agg(product || CASE WHEN version IS NULL THEN '' ELSE '/' || version END, ', ' ORDER BY o) AS line FROM prints GROUP BY scan_id UNION ALL SELECT scan_id, 'none identified' FROM cap WHERE scan_id NOT IN (SELECT scan_id FROM prints)")
def tech_log_line(caps):
    return T.with_prints(H.prepared(caps)).select("scan_id", T.log_line("prints").alias("line"))


@on_captures(f", {_PRINTS}, {_CVES} SELECT * FROM cves")
def cve_offline(caps):
    return T.known_vulnerabilities(caps)


@on_captures(f", {_PRINTS}, {_CVES} SELECT * FROM cves")
def cve_table(caps):
    """cve_offline by a table of entries, joined by equality."""
    found = T.vulnerabilities_by_table(T.fingerprints(caps), caps.sparkSession.sql(T.vulnerability_rows()))
    return exploded(found, F.col("cves")).select(*T._CVE)


# ---- posture

_POST = ("scan_id", "category", "evidence", "severity")


@on_captures("SELECT scan_id, left(url, 160) AS evidence FROM cap WHERE starts_with(lower(url), 'http://')")
def posture_transport(caps):
    return P.transport(caps).select("scan_id", "evidence")


_MISSING = f"SELECT scan_id, e.name AS evidence, e.severity FROM cap CROSS JOIN {values((h, s) for _, h, s in V.EXPECTED_HEADERS)} e(name, severity) WHERE NOT EXISTS (SELECT 1 FROM hdr WHERE hdr.scan_id = cap.scan_id AND hdr.name = e.name AND trim(hdr.value) <> '')"


@on_captures(_MISSING)
def posture_headers(caps):
    return P.missing_headers(caps).select("scan_id", "evidence", "severity")


_CSP = """SELECT scan_id, e AS evidence, s AS severity FROM hdr CROSS JOIN (VALUES ('unsafe-inline', 'low', 'unsafe-inline'), ('unsafe-eval', 'low', 'unsafe-eval'), ('* source', 'medium', '(?:default|script)-src[^;]*[*]')) w(e, s, p)
WHERE name = 'content-security-policy' AND regexp_matches(lower(value), p)"""


@on_captures(_CSP)
def posture_csp(caps):
    return P.csp(caps).select("scan_id", "evidence", "severity")


_CORS = """SELECT a.scan_id, CASE WHEN lower(trim(c.value)) = 'true' THEN 'ACAO:* + ACAC:true' ELSE 'ACAO:*' END AS evidence, CASE WHEN lower(trim(c.value)) = 'true' THEN 'high' ELSE 'low' END AS severity
FROM hdr a LEFT JOIN hdr c ON c.scan_id = a.scan_id AND c.name = 'access-control-allow-credentials' WHERE a.name = 'access-control-allow-origin' AND trim(a.value) = '*'"""


@on_captures(_CORS)
def posture_cors(caps):
    return P.cors(caps).select("scan_id", "evidence", "severity")


_VERS = f"SELECT scan_id, left(name || ': ' || value, 160) AS evidence FROM hdr WHERE name IN ({', '.join(map(quoted, V.VERSIONED_HEADERS))}) AND regexp_matches(value, '[0-9]')"


@on_captures(_VERS)
def posture_versions(caps):
    return P.versions(caps).select("scan_id", "evidence")


_SESS = " OR ".join(f"contains(lower(value), {quoted(h)})" for h in V.SESSION_COOKIE_HINTS)
_COOKIES = f"""SELECT scan_id, left(trim(split_part(value, '=', 1)), 40) AS evidence, CASE WHEN flag = 'samesite' THEN 'info' WHEN {_SESS} THEN 'medium' ELSE 'low' END AS severity
FROM hdr CROSS JOIN (VALUES ('httponly'), ('secure'), ('samesite')) f(flag) WHERE name = 'set-cookie' AND NOT contains(lower(value), flag)"""


@on_captures(_COOKIES)
def posture_cookies(caps):
    return P.cookies(caps).select("scan_id", "evidence", "severity")


_ASSET = "(?i)(?:src|href|action)\\s*=\\s*[\x22\x27](http://[^\x22\x27]+)"
_MIXED = f"SELECT scan_id, unnest(list_sort(list_distinct(regexp_extract_all(html, '{_ASSET}', 1)))[:5]) AS evidence FROM cap WHERE starts_with(lower(url), 'https://')".replace("[\x22\x27]", "[\x22\x27\x27]").replace("[^\x22\x27]", "[^\x22\x27\x27]")


@on_captures(_MIXED)
def posture_mixed(caps):
    return P.mixed_content(caps).select("scan_id", "evidence")


_FORM_ATTR = lambda name: f"trim(coalesce(regexp_extract(form, {quoted('(?is)^<form[^>]*? ' + name + '=[' + chr(34) + chr(39) + ']([^' + chr(34) + chr(39) + ']*)')}, 1), ''))"
_HOST_OF = "lower(regexp_replace(split_part(regexp_extract(action, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)', 1), '@', -1), ':[0-9]*$', ''))"
_FORMS = f"""SELECT scan_id, left(action, 160) AS evidence, 'high' AS severity FROM asks WHERE starts_with(lower(action), 'http://')
UNION ALL SELECT scan_id, host || ' -> ' || {_HOST_OF}, 'medium' FROM asks WHERE NOT starts_with(lower(action), 'http://') AND starts_with(lower(action), 'http') AND {_HOST_OF} <> host
UNION ALL SELECT scan_id, 'no csrf token', 'low' FROM asks WHERE NOT ({" OR ".join(f"contains(names, {quoted(h)})" for h in V.CSRF_FIELD_HINTS)})"""
_ASKS = f"""fm AS (SELECT scan_id, host, unnest(regexp_extract_all(html, '(?is)<form[^>]*>.*?</form>')) AS form FROM cap),
fi AS (SELECT scan_id, host, {_FORM_ATTR('action')} AS action, regexp_extract_all(form, '(?is)<input[^>]*>') AS tags FROM fm),
asks AS (SELECT scan_id, host, action, lower(array_to_string([regexp_extract(t, '(?i) name=.([^"'']*)', 1) for t in tags], ' ')) AS names FROM fi WHERE len([t for t in tags if lower(regexp_extract(t, '(?i) type=.([^"'']*)', 1)) = 'password']) > 0)"""


@on_captures(f", {_ASKS} {_FORMS}")
def posture_forms(caps):
    return P.forms(caps).select("scan_id", "evidence", "severity")


_SECRET = " UNION ALL ".join(
    f"SELECT scan_id, {quoted(lb)} AS label, {quoted(s)} AS severity, " + ("CASE WHEN len(trim(t)) <= 12 THEN left(trim(t), 4) || '…' ELSE left(trim(t), 8) || '…' || right(trim(t), 4) || ' (len ' || len(trim(t)) || ')' END" if hide else quoted(lb)) + f" AS evidence FROM (SELECT scan_id, unnest([x for x, i in regexp_extract_all(html, {quoted(p)}) if list_position(regexp_extract_all(html, {quoted(p)}), x) = i][:3]) AS t FROM cap)"
    for lb, s, p, hide in V.SECRET_PATTERNS
)


@on_captures(_SECRET)
def posture_secrets(caps):
    return P.secrets(caps).select("scan_id", "label", "severity", "evidence")


# ---- landed responses

_PATHS = values((i, p, c, s) for i, (_, p, c, s) in enumerate(V.MISCONFIG_TARGETS)) + " t(i, path, category, severity)"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic probe responses of each page: two baselines and all targets, by arithmetic on the ids."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("scan_id"))
    paths = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(p).alias("path")) for i, (_, p, _, _) in enumerate(V.MISCONFIG_TARGETS)))
    x = (F.col("scan_id") * 7 + F.col("t.ord") * 13) % 11
    targets = pages.select("scan_id", F.explode(paths).alias("t")).select("scan_id", "t.path", F.lit("target").alias("kind"), "t.ord", F.when(x < 3, 200).when(x == 3, 405).otherwise(404).alias("head_status"), F.when(x == 3, 200).otherwise(404).alias("get_status"), F.when(x != 2, (100 + x * 24).cast("string")).alias("content_length"), F.lit(None).cast("int").alias("body_len"))
    targets = targets.where("(scan_id + ord) % 7 != 5")
    base = pages.select("scan_id", F.lit("/none").alias("path"), F.lit("baseline").alias("kind"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), F.lit(0).alias("head_status"), F.when(F.col("scan_id") % 2 == 0, 200).otherwise(404).alias("get_status"), F.lit(None).cast("string").alias("content_length"), (F.lit(100) + F.col("ord")).cast("int").alias("body_len"))
    return targets.union(base)


#: Paths whose number is 5 or 6 modulo 7 have no response at all.
_MISCONFIG = f"""SELECT scan_id, path, CAST(CASE WHEN silent THEN 0 WHEN x <= 3 THEN 200 ELSE 404 END AS INTEGER) AS status, exposed, category, CASE WHEN exposed THEN severity ELSE 'info' END AS severity
FROM (SELECT *, NOT silent AND x <= 3 AND NOT (scan_id % 2 = 0 AND (x = 2 OR abs(100 + x * 24 - 100) <= 24)) AS exposed
FROM (SELECT page_id AS scan_id, path, category, severity, (page_id * 7 + i * 13) % 11 AS x, (page_id + i) % 7 = 5 AS silent FROM pages CROSS JOIN {_PATHS}))"""


@query(_MISCONFIG)
def misconfig_exposed(spark, sf_dir):
    return N.misconfigurations(probes(spark, sf_dir))


_HOSTS = "SELECT scan_id, host AS key FROM cap"
_DOMAINS = f"SELECT scan_id, {_REG} AS key FROM cap WHERE host <> '' AND NOT regexp_matches(host, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$')"
_TERMS = "SELECT scan_id, lower(product || ' ' || version) AS key FROM prints WHERE coalesce(version, '') <> ''"
_JSON = lambda keys, body: f"(SELECT key, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM ({L.responses_sql(keys, body)}))"


_V3, _V2 = "'$.cve.metrics.cvssMetricV31[0].cvssData.", "'$.cve.metrics.cvssMetricV2[0]."
_NVD = f"""nv AS (SELECT key, generate_subscripts(l, 1) - 1 AS ord, unnest(l) AS v FROM (SELECT key, CAST(j -> '$.vulnerabilities' AS JSON[]) AS l FROM {_JSON(_TERMS, L.ADVISORIES)})),
records AS (SELECT key AS product, CAST(ord AS INTEGER) AS ord, v ->> '$.cve.id' AS cve_id, upper(coalesce(v ->> {_V3}baseSeverity', v ->> {_V2}baseSeverity', 'UNKNOWN')) AS severity,
  CAST(coalesce(v ->> {_V3}baseScore', v ->> {_V2}cvssData.baseScore') AS DOUBLE) AS score, left([x ->> '$.value' for x in CAST(v -> '$.cve.descriptions' AS JSON[]) if x ->> '$.lang' = 'en'][1], 400) AS summary
  FROM nv WHERE coalesce(v ->> '$.cve.id', '') <> '' AND ord < 10)"""


@on_captures(f", {_PRINTS}, {_NVD} SELECT * FROM records")
def cve_nvd_parse(caps):
    return _advisories_of(T.fingerprints(caps))


def _advisories_of(prints: DataFrame) -> DataFrame:
    prints = prints.where("coalesce(version, '') != ''")
    raw = L.responses(prints.select("scan_id", F.lower(F.concat_ws(" ", "product", "version")).alias("term")), "term", L.ADVISORIES)
    return N.advisories(raw.withColumnRenamed("key", "product"))


_VCARD = lambda at, field: f"[x ->> '$[3]' for x in coalesce(CAST(j -> '{at}.vcardArray[1]' AS JSON[]), []) if x ->> '$[0]' = '{field}'][1]"
_WITHIN = lambda depth: f"CASE WHEN j ->> '$.entities[0]{'.entities[0]' * depth}.roles[0]' = 'abuse' THEN {_VCARD('$.entities[0]' + '.entities[0]' * depth, 'email')} END"
_RDAP = f"""rd AS (SELECT key AS domain, CASE WHEN j ->> '$.entities[0].roles[0]' = 'registrar' THEN {_VCARD('$.entities[0]', 'fn')} END AS registrar, coalesce({", ".join(map(_WITHIN, range(6)))}) AS abuse_email,
  [x ->> '$.eventDate' for x in coalesce(CAST(j -> '$.events' AS JSON[]), []) if lower(x ->> '$.eventAction') IN ('registration', 'created')][1] AS created,
  coalesce(array_to_string([lower(x ->> '$.ldhName') for x in coalesce(CAST(j -> '$.nameservers' AS JSON[]), [])][:6], ','), '') AS nameservers FROM {_JSON(_DOMAINS, L.RDAP)})"""


@on_captures(f", {_RDAP} SELECT * FROM rd")
def rdap_domain(caps):
    return N.domain_registrations(L.responses(caps.select("scan_id", urls.host_of(F.col("url")).alias("h")).select("scan_id", F.when(~urls.is_ipv4(F.col("h")), urls.registrable(F.col("h"))).alias("domain")), "domain", L.RDAP))


@on_captures(f", {_RDAP} SELECT domain AS key, abuse_email FROM rd")
def rdap_contacts(caps):
    """Abuse contacts of domains by a recursive query over nested entities."""
    keys = caps.select("scan_id", urls.host_of(F.col("url")).alias("h")).select("scan_id", F.when(~urls.is_ipv4(F.col("h")), urls.registrable(F.col("h"))).alias("domain"))
    return abuse_contacts(L.responses(keys, "domain", L.RDAP))


_IP_RDAP = f"""ad AS (SELECT key AS address, j ->> '$.name' AS provider, {_WITHIN(0)} AS abuse_email, 'AS' || coalesce(j ->> '$.arin_originas0_originautnumbers[0]', j ->> '$.originAutnums[0]') AS asn FROM {_JSON(_HOSTS, L.ADDRESS)})"""


@on_captures(f", {_IP_RDAP} SELECT * FROM ad")
def rdap_ip(caps):
    return N.address_registrations(L.responses(caps.select("scan_id", urls.host_of(F.col("url")).alias("host")), "host", L.ADDRESS))


_AGE = "CASE WHEN created IS NOT NULL THEN greatest(0, datesub('day', CAST(left(replace(created, 'Z', ''), 19) AS TIMESTAMP), TIMESTAMP '2026-06-26 00:00:00')) END"


@on_captures(f", {_RDAP} SELECT domain, CAST({_AGE} AS INTEGER) AS age_days FROM rd")
def domain_age(caps):
    known = rdap_domain.of(caps)
    return known.select("domain", N.age_days("created", F.lit(L.NOW).cast("timestamp")).alias("age_days"))


_SEEN = "TIMESTAMP '2026-06-01 00:00:00' + INTERVAL 1 HOUR * CAST({} AS INTEGER)"


@on_captures(f""", seen AS (SELECT {_REG} AS domain, {_SEEN.format("(scan_id * 13) % 101")} AS seen_at, max(scan_id) AS registration FROM cap WHERE host <> '' GROUP BY ALL),
taken AS (SELECT scan_id, {_REG} AS domain, {_SEEN.format("scan_id % 97")} AS captured_at FROM cap)
SELECT taken.scan_id, taken.domain, seen.registration FROM taken ASOF LEFT JOIN seen ON taken.domain = seen.domain AND taken.captured_at >= seen.seen_at""")
def registration_as_of(caps):
    """The last registration of a capture's domain that was seen by the time of the capture; times are made up."""
    hour = lambda n: F.expr(f"TIMESTAMP '2026-06-01 00:00:00' + make_dt_interval(0, CAST({n} AS INT))")
    rows = caps.select("scan_id", urls.registrable(urls.host_of(F.col("url"))).alias("domain"), urls.host_of(F.col("url")).alias("host"))
    seen = rows.where("host != ''").groupBy("domain", hour("(scan_id * 13) % 101").alias("seen_at")).agg(F.max("scan_id").alias("registration"))
    taken = rows.select("scan_id", "domain", hour("scan_id % 97").alias("captured_at"))
    return as_of(taken, seen, "domain", "captured_at", "seen_at").select("scan_id", "domain", "state.registration")


_SIBLINGS = f"""ct AS (SELECT key AS domain, generate_subscripts(l, 1) AS i, unnest(l) ->> '$.name_value' AS names FROM (SELECT key, CAST(j AS JSON[]) AS l FROM {_JSON(_DOMAINS, L.CERTIFICATES)})),
cn AS (SELECT domain, i, generate_subscripts(string_split(names, chr(10)), 1) AS n, lower(ltrim(unnest(string_split(names, chr(10))), '*.')) AS name FROM ct),
cs AS (SELECT domain, name, row_number() OVER (PARTITION BY domain ORDER BY i, n) AS r FROM (SELECT domain, name, min(i) AS i, min_by(n, i * 1000 + n) AS n FROM cn WHERE name <> '' AND NOT contains(name, domain) GROUP BY domain, name))"""


@on_captures(f", {_SIBLINGS} SELECT domain, CAST(r - 1 AS INTEGER) AS ord, name FROM cs WHERE r <= 25")
def ct_siblings(caps):
    keys = caps.select("scan_id", urls.host_of(F.col("url")).alias("h")).select("scan_id", F.when(~urls.is_ipv4(F.col("h")), urls.registrable(F.col("h"))).alias("domain"))
    return N.certificate_siblings(L.responses(keys, "domain", L.CERTIFICATES))


@query("SELECT page_id AS scan_id, left(sha256(html), 32) AS favicon_hash FROM pages")
def favicon_hash(spark, sf_dir):
    """Of the bytes of a page, in place of an icon's, which the pages have none of."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("scan_id"), N.icon_hash(F.col("html").cast("binary")).alias("favicon_hash"))


_HAUS = f"haus AS (SELECT key AS host, CAST(coalesce(TRY_CAST(j ->> '$.url_count' AS BIGINT), json_array_length(j, '$.urls')) AS INTEGER) AS urls FROM {_JSON(_HOSTS, L.URLHAUS)} WHERE j ->> '$.query_status' = 'ok' AND (json_array_length(j, '$.urls') > 0 OR coalesce(j ->> '$.url_count', '0') <> '0'))"
_SB = f"sb AS (SELECT key AS host, array_to_string(list_sort(list_distinct([coalesce(x ->> '$.threatType', '?') for x in CAST(j -> '$.matches' AS JSON[])])), ', ') AS threats FROM {_JSON(_HOSTS, L.SAFE_BROWSING)} WHERE json_array_length(j, '$.matches') > 0)"


@on_captures(f", {_HAUS} SELECT * FROM haus")
def feed_hits(caps):
    return N.feed_hits(L.responses(caps.select("scan_id", urls.host_of(F.col("url")).alias("host")), "host", L.URLHAUS))


@on_captures(f", {_SB} SELECT * FROM sb")
def safe_browsing_summary(caps):
    return N.safe_browsing(L.responses(caps.select("scan_id", urls.host_of(F.col("url")).alias("host")), "host", L.SAFE_BROWSING))


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.floor(F.get(F.col("embedding"), i % 64).cast("double") * 1000))
    return emb.select(F.col("vec_id").alias("id"), pixels.alias("pixels")).select("id", N.difference_hash("pixels").alias("hash"))


_BITS = " || ".join(f"CASE WHEN p[{i // 8 * 9 + i % 8 + 1}] > p[{i // 8 * 9 + i % 8 + 2}] THEN '1' ELSE '0' END" for i in range(64))
_SHOT_CTES = f"""px AS (SELECT vec_id AS id, [floor(CAST(embedding[(i % 64) + 1] AS DOUBLE) * 1000) for i in range(72)] AS p FROM embeddings), h AS (SELECT id, {_BITS} AS bits FROM px)"""
_SHOT_SQL = f"WITH {_SHOT_CTES}"


@query()
def screenshot_hash(spark, sf_dir):
    """Hashes of synthetic colour screenshots of vectors: 40 by 30 pixels, shrunk to 9 by 8."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("size(embedding) > 0")
    value = lambda i: F.pmod(F.floor(F.get(F.col("embedding"), (i * 7 + F.floor(i / 120)) % F.size("embedding")).cast("double") * 997), F.lit(256)).cast("int")
    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(40 * 30 * 3 - 1)), lambda i: F.lpad(F.hex(value(i)), 2, "0")), ""))
    shots = emb.select(F.col("vec_id").alias("id"), F.lit(40).alias("width"), F.lit(30).alias("height"), F.lit(3).alias("channels"), pixels.alias("pixels"))
    return I.hashed(shots).select("id", "hash")


@query(f"{_SHOT_SQL} SELECT id, bits FROM h")
def dhash_bits(spark, sf_dir):
    return _shots(spark, sf_dir).select("id", F.lpad(F.bin("hash"), 64, "0").alias("bits"))


@query(f"{_SHOT_SQL} SELECT a.id, 'brand' || b.id AS brand, CAST(hamming(a.bits, b.bits) AS INTEGER) AS distance FROM h a JOIN h b ON b.id % 100 = 0 AND hamming(a.bits, b.bits) <= 12")
def visual_matches(spark, sf_dir):
    shots = _shots(spark, sf_dir)
    brands = shots.where("id % 100 = 0").select(F.concat(F.lit("brand"), "id").alias("brand"), "hash")
    return N.visual_matches(shots, brands).select("id", "brand", "distance")


# ---- risk

_PTS = "CASE lower(severity) " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in V.SEVERITY_POINTS.items()) + " ELSE 1 END"


def landed_of(spark: SparkSession, sf_dir: str, found: DataFrame) -> S.Landed:
    """The synthetic responses that the queries above take, for analysed captures; the screenshot with a page's id is the page's."""
    of = lambda name: QUERIES[name].of(found)
    return S.Landed(
        paths=misconfig_exposed(spark, sf_dir),
        registrations=of("rdap_domain"),
        now=F.lit(L.NOW).cast("timestamp"),
        hosting=of("rdap_ip").withColumnRenamed("address", "host"),
        feeds=(of("feed_hits"), of("safe_browsing_summary")),
        looks=visual_matches(spark, sf_dir).withColumnRenamed("id", "scan_id"),
        siblings=of("ct_siblings"),
        records=_advisories_of(exploded(found, F.col("prints"))),
        codes=codes(spark, sf_dir),
    )


def with_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with all findings and what landed. Pages are read and parsed once: findings are written, and what is looked up
    and joined starts from them."""
    found = written(S.analysed(captures(spark, sf_dir)), "analysed")
    return S.with_landed(found, landed_of(spark, sf_dir, found))


_WEAK = f"""weak AS (SELECT scan_id, 'medium' AS severity FROM cap WHERE starts_with(lower(url), 'http://') UNION ALL SELECT scan_id, severity FROM ({_MISSING}) UNION ALL SELECT scan_id, severity FROM ({_CSP})
  UNION ALL SELECT scan_id, severity FROM ({_CORS}) UNION ALL SELECT scan_id, 'low' FROM ({_VERS}) UNION ALL SELECT scan_id, severity FROM ({_COOKIES}) UNION ALL SELECT scan_id, 'low' FROM ({_MIXED}) UNION ALL SELECT scan_id, severity FROM ({_FORMS})),
leaks AS ({_SECRET})"""
#: Of pages alone: (scan_id, bucket, w).
_PAGE_WEIGHTS = f"""{_BRAND}, {_ALL_HITS}, {_PRINTS}, {_CVES}, {_ASKS}, {_WEAK}"""
_OF_PAGES = f"""SELECT scan_id, 'scam' AS bucket, weight AS w FROM hits UNION ALL SELECT scan_id, 'cve', {_PTS} FROM cves UNION ALL SELECT scan_id, 'posture', {_PTS} FROM weak UNION ALL SELECT scan_id, 'exposure', {_PTS} FROM leaks"""
_SCORES = lambda w: f"""w AS ({w}), rk AS (SELECT scan_id, bucket, w * pow(0.6, row_number() OVER (PARTITION BY scan_id, bucket ORDER BY w DESC) - 1) AS part FROM w),
sc AS (SELECT scan_id, bucket, CAST(count(*) AS BIGINT) AS findings, CAST(least(round_even(round(sum(part), 9), 0), CASE bucket {" ".join(f"WHEN '{b}' THEN {c}" for b, c in V.BUCKET_CAPS.items())} END) AS INTEGER) AS score FROM rk GROUP BY scan_id, bucket)"""  # noqa: E731
_LEVEL = "CASE " + " ".join(f"WHEN score >= {n} THEN '{name}'" for n, name in reversed(V.RISK_BANDS)) + " END"
_TOTAL = f"tot AS (SELECT cap.scan_id, CAST(least(100, coalesce(sum(score), 0)) AS INTEGER) AS score FROM cap LEFT JOIN sc ON sc.scan_id = cap.scan_id GROUP BY cap.scan_id)"
#: With what landed.
_AGE_PTS = "CASE " + " ".join(f"WHEN age <= {n} THEN {p}" for n, p in V.DOMAIN_AGE_POINTS) + " END"
_VISUAL = lambda cte: f"SELECT a.id, 'brand' || b.id AS brand, CAST(hamming(a.bits, b.bits) AS INTEGER) AS distance FROM {cte} a JOIN {cte} b ON b.id % 100 = 0 AND hamming(a.bits, b.bits) <= 12"
_ALL_WEIGHTS = f"""{_PAGE_WEIGHTS}, {_NVD}, {_RDAP}, {_HAUS}, {_SB}, {_SHOT_CTES},
allcves AS (SELECT scan_id, cve_id, kind, severity FROM (SELECT scan_id, cve_id, kind, severity, -1 AS o, -1 AS ord FROM cves UNION ALL SELECT scan_id, cve_id, 'cve', severity, o, ord FROM prints JOIN records ON lower(prints.product || ' ' || prints.version) = records.product) QUALIFY row_number() OVER (PARTITION BY scan_id, cve_id ORDER BY o, ord) = 1),
qr AS ({_QR_SQL}), paths AS (SELECT * FROM ({_MISCONFIG}) WHERE exposed), looks AS ({_VISUAL('h')}),
ages AS (SELECT scan_id, {_AGE} AS age FROM cap JOIN rd ON rd.domain = {_REG} WHERE created IS NOT NULL AND host <> ''),
fed AS (SELECT scan_id FROM cap JOIN haus ON haus.host = cap.host UNION ALL SELECT scan_id FROM cap JOIN sb ON sb.host = cap.host),
pg AS (SELECT scan_id FROM cap)"""
_OF_ALL = f"""SELECT scan_id, 'scam' AS bucket, weight AS w FROM hits UNION ALL SELECT scan_id, 'scam', weight FROM qr UNION ALL SELECT scan_id, 'cve', {_PTS} FROM allcves UNION ALL SELECT scan_id, 'posture', {_PTS} FROM weak UNION ALL SELECT scan_id, 'exposure', {_PTS} FROM leaks
UNION ALL SELECT scan_id, 'misconfig', {_PTS} FROM paths UNION ALL SELECT scan_id, 'intel', {_AGE_PTS} FROM ages WHERE age <= {V.DOMAIN_AGE_POINTS[-1][0]} UNION ALL SELECT scan_id, 'intel', {V.FEED_POINTS} FROM fed UNION ALL SELECT id, 'intel', {V.VISUAL_POINTS} FROM looks WHERE id IN (SELECT scan_id FROM pg)"""


def _bucket_rows(df: DataFrame) -> DataFrame:
    return df.select("scan_id", F.explode_outer("buckets").alias("b")).select("scan_id", "b.bucket", "b.findings", "b.score").where("findings > 0")


@on_captures(f"{_PAGE_WEIGHTS}, {_SCORES(_OF_PAGES)} SELECT * FROM sc")
def risk_buckets(caps):
    return _bucket_rows(R.with_buckets(S.with_landed(S.analysed(caps))))


@on_captures(f"{_PAGE_WEIGHTS}, {_SCORES(_OF_PAGES)}, {_TOTAL} SELECT scan_id, score, {_LEVEL} AS level FROM tot")
def risk_verdict_pages(caps):
    return S.verdicts_of(caps).select("scan_id", "score", "level")


@query(f"{_CAP}{_ALL_WEIGHTS}, {_SCORES(_OF_ALL)} SELECT * FROM sc")
def risk_buckets_all(spark, sf_dir):
    """risk_buckets over all six buckets: with what landed."""
    return _bucket_rows(R.with_buckets(with_landed(spark, sf_dir)))


_LINES = f"""li AS (SELECT tot.scan_id, coalesce(string_agg(CASE bucket WHEN 'scam' THEN 'Scam heuristics: ' || findings || ' signal(s)' WHEN 'cve' THEN 'Known vulns: ' || findings WHEN 'misconfig' THEN 'Exposed sensitive paths: ' || findings
  WHEN 'posture' THEN 'Security posture: ' || findings || ' weakness(es)' WHEN 'exposure' THEN 'Leaked secrets/data: ' || findings
  ELSE 'Intelligence (' || concat_ws(', ', CASE WHEN ages.age IS NOT NULL THEN 'age ' || ages.age || 'd' END, CASE WHEN tot.scan_id IN (SELECT scan_id FROM fed) THEN 'feed-listed' END, CASE WHEN tot.scan_id IN (SELECT id FROM looks) THEN 'visual match' END) || '):' END || ' (+' || sc.score || ')', '; '
  ORDER BY CASE bucket {" ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(V.BUCKET_CAPS))} END), '') AS contributions FROM tot LEFT JOIN sc ON sc.scan_id = tot.scan_id AND sc.score > 0 LEFT JOIN ages ON ages.scan_id = tot.scan_id GROUP BY tot.scan_id)"""
_CATS = f"""cats AS (SELECT scan_id, category FROM ({_LEX_SQL}) UNION ALL SELECT scan_id, 'ph_currency' FROM cap WHERE {_CUR} UNION ALL SELECT scan_id, category FROM ({_RX}) UNION ALL SELECT scan_id, 'obfuscation' FROM ({_OBF}) UNION ALL SELECT scan_id, 'credential_harvest' FROM cred
  UNION ALL SELECT scan_id, 'brand_impersonation' FROM brand UNION ALL SELECT scan_id, 'domain_reputation' FROM ({_DOM}) UNION ALL SELECT scan_id, 'url_anomaly' FROM ({_ANOM}))"""
_IN = lambda names: "(" + ", ".join(map(quoted, names)) + ")"
_N = lambda table, alias, key="scan_id", test="true": f"(SELECT count(*) FROM {table} x WHERE x.{key} = tot.scan_id AND {test}) AS {alias}"
_SUMMARY = f"""dr AS (SELECT tot.scan_id, tot.score, {_N('cats2', 'phishing', test='category IN ' + _IN(V.PHISHING_CATEGORIES))}, {_N('cats2', 'scam', test="(starts_with(category, 'scam_') OR category IN " + _IN(V.SCAM_CATEGORIES) + ')')},
  {_N('allcves', 'vulns')}, {_N('allcves', 'real', test="kind = 'cve'")}, {_N('paths', 'exposed')}, {_N('leaks', 'secrets')}, {_N('fed', 'feeds')}, {_N('looks', 'visual', 'id')}, {_N('weak', 'posture')}, (SELECT max(age) FROM ages a WHERE a.scan_id = tot.scan_id) AS age FROM tot),
su AS (SELECT *, concat_ws('; ', CASE WHEN phishing > 0 THEN 'active phishing / credential harvesting' END, CASE WHEN scam > 0 THEN scam || ' scam signal(s)' END, CASE WHEN vulns > 0 THEN CASE WHEN real > 0 THEN real ELSE vulns END || ' known vuln(s)' END,
  CASE WHEN exposed > 0 THEN exposed || ' exposed sensitive path(s)' END, CASE WHEN secrets > 0 THEN secrets || ' leaked secret(s)' END, CASE WHEN feeds > 0 THEN 'listed on an external threat feed' END, CASE WHEN visual > 0 THEN 'visual brand impersonation' END,
  CASE WHEN age <= {V.YOUNG_DOMAIN_DAYS} THEN 'domain only ' || age || ' day(s) old' END) AS d FROM dr)"""


@query(f"{_CAP}{_ALL_WEIGHTS}, {_SCORES(_OF_ALL)}, {_TOTAL}, {_LINES}, {_CATS}, cats2 AS (SELECT * FROM cats UNION ALL SELECT scan_id, 'payment_qr' FROM qr), {_SUMMARY} SELECT su.scan_id, score, {_LEVEL} AS level, contributions, {_LEVEL} || ' risk - driven by ' || CASE WHEN d <> '' THEN d WHEN posture > 0 THEN 'weak security posture' ELSE 'no notable findings' END || '.' AS summary FROM su JOIN li ON li.scan_id = su.scan_id")
def risk_verdict(spark, sf_dir):
    return S.shown(R.with_verdict(with_landed(spark, sf_dir)))


# ---- history and reports


def scans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of the case store for each capture; four ids in turn count as scans of one target."""
    scans = S.fingerprints_of(R.with_verdict(with_landed(spark, sf_dir)))
    return scans.select(F.col("scan_id").alias("id"), F.concat(F.lit("target "), F.floor(F.col("scan_id") / 4)).alias("target_url"), F.lit("2026-06-26T00:00:00Z").alias("timestamp"), "fingerprint")


_SET = lambda table, column, key="scan_id", distinct=True: f"coalesce((SELECT list_sort({'list_distinct(list(' + column + '))' if distinct else 'list(' + column + ')'}) FROM {table} x WHERE x.{key} = tot.scan_id), CAST([] AS VARCHAR[]))"
_ROWS = f"""sl AS (SELECT tot.scan_id AS id, 'target ' || (tot.scan_id // 4) AS target_url, score, {_LEVEL} AS level, {_SET('paths', 'path', distinct=False)} AS paths, {_SET('allcves', 'cve_id', distinct=False)} AS vulns, {_SET('cats2', 'category')} AS cats, {_SET('leaks', 'evidence')} AS leaks, sha256(html) AS dom FROM tot JOIN cap ON cap.scan_id = tot.scan_id)"""
_SCANS = f"""{_ALL_WEIGHTS}, {_SCORES(_OF_ALL)}, {_TOTAL}, {_CATS}, cats2 AS (SELECT * FROM cats UNION ALL SELECT scan_id, 'payment_qr' FROM qr),
{_ROWS}"""
#: The same of pages alone.
_PAGE_SCANS = f"""{_PAGE_WEIGHTS}, {_SCORES(_OF_PAGES)}, {_TOTAL}, {_CATS}, cats2 AS (SELECT * FROM cats), paths AS (SELECT 0 AS scan_id, '' AS path WHERE false), allcves AS (SELECT * FROM cves), {_ROWS}"""


@query(f"{_CAP}{_SCANS} SELECT id, target_url, level AS risk_level, score AS risk_score, array_to_string(paths, ',') AS exposed, array_to_string(vulns, ',') AS cves, array_to_string(cats, ',') AS scam_categories, array_to_string(leaks, ',') AS secrets, dom AS dom_sha256 FROM sl")
def scan_fingerprint(spark, sf_dir):
    joined = (F.concat_ws(",", f"fingerprint.{c}").alias(c) for c in ("exposed", "cves", "scam_categories", "secrets"))
    return scans_of(spark, sf_dir).select("id", "target_url", "fingerprint.risk_level", "fingerprint.risk_score", *joined, "fingerprint.dom_sha256")


_LINE = lambda verb, label, a, b: f"CASE WHEN len([x for x in {a} if NOT list_contains({b}, x)]) > 0 THEN '{verb} {label}(s): ' || left(array_to_string(list_distinct_sorted([x for x in {a} if NOT list_contains({b}, x)]), ', '), 200) || '.' END".replace("list_distinct_sorted(", "list_sort(list_distinct(").replace("x)]), ', ')", "x)])), ', ')")


_DIFF_ROWS = f"""lg AS (SELECT *, lag(level) OVER o AS l0, lag(score) OVER o AS s0, lag(paths) OVER o AS p0, lag(vulns) OVER o AS v0, lag(cats) OVER o AS c0, lag(leaks) OVER o AS k0, lag(dom) OVER o AS d0 FROM sl WINDOW o AS (PARTITION BY target_url ORDER BY id)),
ln AS (SELECT id, target_url, l0, concat_ws(chr(10), CASE WHEN l0 <> level THEN 'Risk changed: ' || l0 || ' -> ' || level || ' (score ' || s0 || ' -> ' || score || ').' END, {", ".join(_LINE(verb, label, *pair) for label, now, old in (("exposed path", "paths", "p0"), ("known vuln", "vulns", "v0"), ("scam signal", "cats", "c0"), ("leaked secret", "leaks", "k0")) for verb, pair in (("New", (now, old)), ("Resolved", (old, now))))}, CASE WHEN d0 <> dom THEN 'Page content changed since the previous scan.' END) AS c FROM lg),
df AS (SELECT id, target_url, CASE WHEN l0 IS NULL THEN 'First recorded scan of this target — no baseline to compare.' WHEN c = '' THEN 'No material change since the previous scan.' ELSE c END AS changes FROM ln)"""
_DIFF = f"{_DIFF_ROWS} SELECT * FROM df"


@query(f"{_CAP}{_SCANS}, {_DIFF}")
def scan_diff(spark, sf_dir):
    return D.diffs(scans_of(spark, sf_dir))


@query(f"{_CAP}, {_PAGE_SCANS.removeprefix(', ')}, {_DIFF}")
def scan_store_stream(spark, sf_dir):
    """What changed, of captures that land in a stream, each against the last one in its target's state."""
    scans = S.fingerprints_of(S.scanned(capture_stream(spark, sf_dir)))
    scans = scans.select("scan_id", F.concat(F.lit("target "), F.floor(F.col("scan_id") / 4)).alias("target_url"), F.lit("2026-06-26T00:00:00Z").alias("timestamp"), "fingerprint")
    store = fresh_dir(spark, "store")
    store_scans(scans, store, fresh_dir(spark, "state")).awaitTermination()
    return stored(spark, store).select(F.col("scan_id").alias("id"), "target_url", "changes")


@query(f"{_CAP}{_SCANS} SELECT target_url, max(id) AS id, arg_max(level, id) AS risk_level FROM sl GROUP BY target_url")
def latest_scan(spark, sf_dir):
    return D.latest(scans_of(spark, sf_dir))


@query(f"{_CAP}{_SCANS} SELECT id, level AS risk_level, score AS risk_score FROM sl WHERE target_url = 'target 3'")
def scan_history(spark, sf_dir):
    return D.history(scans_of(spark, sf_dir), "target 3")


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans with the time, and what changed; four ids in turn count as scans of one target."""
    scans = S.fingerprints_of(R.with_verdict(with_landed(spark, sf_dir))).withColumn("timestamp", F.lit("2026-06-26T00:00:00Z"))
    return D.with_changes(scans.withColumn("target", F.floor(F.col("scan_id") / 4)), "target", "scan_id")


@query()
def report_json(spark, sf_dir):
    """One JSON document for each scan."""
    return X.json_reports(_reported(spark, sf_dir)).select("scan_id", "name", "report")


_OR_UNKNOWN = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'unknown')"
_REPORTED = f"""{_CAP}{_ALL_WEIGHTS}, {_SCORES(_OF_ALL)}, {_TOTAL}, {_CATS}, cats2 AS (SELECT * FROM cats UNION ALL SELECT scan_id, 'payment_qr' FROM qr), {_SIBLINGS}, {_IP_RDAP}, {_ROWS}, {_DIFF_ROWS},
st AS (SELECT cap.scan_id, url, host, {_REG} AS domain, score, {_LEVEL} AS level, left(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 80) || '_20260626000000' AS stem,
  concat_ws(', ', CASE WHEN host IN (SELECT host FROM haus) THEN 'URLhaus' END, CASE WHEN host IN (SELECT host FROM sb) THEN 'Google Safe Browsing' END) AS sources,
  coalesce((SELECT string_agg(path, ', ' ORDER BY path) FROM paths x WHERE x.scan_id = cap.scan_id), '') AS exposed, (SELECT count(*) FROM paths x WHERE x.scan_id = cap.scan_id) AS n_exposed,
  (SELECT string_agg(brand, ', ' ORDER BY brand) FROM looks x WHERE x.id = cap.scan_id) AS alike, (SELECT string_agg(name, ', ' ORDER BY r) FROM cs WHERE cs.domain = {_REG} AND r <= {V.MOST_NAMED_SIBLINGS}) AS shares,
  (SELECT count(*) FROM cats2 x WHERE x.scan_id = cap.scan_id AND (starts_with(category, 'scam_') OR category IN ('brand_impersonation', 'fake_gateway', 'payment_qr'))) AS scam
  FROM cap JOIN tot ON tot.scan_id = cap.scan_id)"""
_DRAFT = ", ".join(
    (
        "'Request to take down a page (draft: check before sending)'",
        "'Page: ' || url",
        "'Captured at: 2026-06-26T00:00:00Z'",
        "'Verdict: ' || level || ' (' || score || ' of 100)'",
        "'To:'",
        f"'  * registrar (' || {_OR_UNKNOWN('rd.registrar')} || '): ' || rd.abuse_email",
        f"'  * host (' || {_OR_UNKNOWN('provider')} || '): ' || ad.abuse_email",
        *(quoted(f"  * {d}") for d in V.ABUSE_DESKS),
        f"'Registrar: ' || {_OR_UNKNOWN('rd.registrar')}",
        f"'Domain age: ' || {_OR_UNKNOWN('age')} || ' days (created ' || {_OR_UNKNOWN('created')} || ')'",
        f"'Hosted by: ' || {_OR_UNKNOWN('provider')} || coalesce(' (' || asn || ')', '')",
        "'Scam indicators: ' || scam",
        "'Exposed paths: ' || n_exposed || CASE WHEN exposed <> '' THEN ': ' || exposed ELSE '' END",
        "'Threat feeds: ' || CASE WHEN sources <> '' THEN 'listed (' || sources || ')' ELSE 'not listed' END",
        "'Looks like: ' || alike",
        "'Shares certificates with: ' || shares",
        "'Evidence and a manifest of SHA-256 digests are attached. Found by an automatic, passive scan: verify before acting.'",
    )
)


@query(f"{_REPORTED} SELECT st.scan_id, 'abuse_' || stem || '.txt' AS name, concat_ws(chr(10), {_DRAFT}) AS abuse_text FROM st LEFT JOIN rd ON rd.domain = st.domain LEFT JOIN ad ON ad.address = st.host LEFT JOIN ages ON ages.scan_id = st.scan_id")
def abuse_text(spark, sf_dir):
    return X.abuse_texts(_reported(spark, sf_dir)).select("scan_id", "name", "abuse_text")


@query(
    f"""{_REPORTED} SELECT st.scan_id, 'report_' || stem || '.json' AS name, url AS target_url, CAST(score AS BIGINT) AS score, level, CAST({_N("cats2", "n_hits").replace("tot.", "st.").removesuffix(" AS n_hits")} AS BIGINT) AS n_hits,
CAST((SELECT count(*) FROM allcves x WHERE x.scan_id = st.scan_id) AS BIGINT) AS n_cves, CAST(n_exposed AS BIGINT) AS n_paths,
CAST((SELECT count(*) FROM weak x WHERE x.scan_id = st.scan_id) + (SELECT count(*) FROM leaks x WHERE x.scan_id = st.scan_id) AS BIGINT) AS n_findings, sources, coalesce(nameservers, '') AS nameservers, changes
FROM st LEFT JOIN rd ON rd.domain = st.domain JOIN df ON df.id = st.scan_id"""
)
def report_fields(spark, sf_dir):
    """What the JSON reports say, read back."""
    kind = "target_url string, heuristics array<struct<rule_id:string>>, cves array<struct<cve_id:string>>, misconfigs array<struct<path:string>>, security_findings array<struct<category:string>>, intel struct<nameservers:array<string>>, threat_intel array<struct<source:string>>, risk struct<score:bigint,level:string>, diff_summary array<string>"
    said = report_json(spark, sf_dir).select("scan_id", "name", F.from_json("report", kind).alias("r"))
    counts = (F.size(f"r.{f}").cast("bigint").alias(n) for f, n in (("heuristics", "n_hits"), ("cves", "n_cves"), ("misconfigs", "n_paths"), ("security_findings", "n_findings")))
    return said.select("scan_id", "name", "r.target_url", "r.risk.score", "r.risk.level", *counts, F.array_join("r.threat_intel.source", ", ").alias("sources"), F.array_join("r.intel.nameservers", ",").alias("nameservers"), F.array_join("r.diff_summary", "\n").alias("changes"))


@query("SELECT page_id || '.html' AS name, sha256(html) AS sha256 FROM pages")
def evidence_manifest(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat("page_id", F.lit(".html")).alias("name"), F.sha2("html", 256).alias("sha256"))
