"""Synthetic landed responses for captures: bodies as services send them, by arithmetic on the ids of scans.

Each body is one SQL expression of the integer k, the least scan_id of its key, and of key; Spark and the checking SQL
evaluate the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOW = "2026-06-26 00:00:00"


def _text(template: str) -> str:
    """SQL of a text with <k> and <key> in it; ^ stands for a backslash."""
    out = "'" + template.replace("'", "''") + "'"
    return out.replace("<k>", "' || CAST(k AS STRING) || '").replace("<key>", "' || key || '").replace("^", "' || chr(92) || '")


def _case(n: int, *templates: str) -> str:
    return f"CASE CAST(k % {n} AS INT) " + " ".join(f"WHEN {i} THEN {_text(t)}" for i, t in enumerate(templates)) + " END"


def _card(field: str, said: str) -> str:
    return f'"vcardArray":["vcard",[["version",{{}},"text","4.0"],["{field}",{{}},"text","{said}"]]]'


def _nested(depth: int) -> str:
    inner = f'{{"roles":["abuse"],{_card("email", "deep@<k>.test")}}}'
    for _ in range(depth - 1):
        inner = f'{{"roles":["technical"],"entities":[{inner}]}}'
    return inner


_REGISTRAR = f'{{"roles":["registrar"],{_card("fn", "Registrar <k>")},"entities":[{{"roles":["abuse"],{_card("email", "abuse@reg<k>.test")}}}]}}'
#: By domain: with all fields; created a few days ago, as a bare date; without a registration event; not JSON; contact five levels down.
RDAP = _case(
    6,
    f'{{"events":[{{"eventAction":"Registration","eventDate":"2026-06-16T12:00:00Z"}}],"entities":[{_REGISTRAR}],"nameservers":[{{"ldhName":"NS1.<key>"}},{{"ldhName":"ns2.<key>"}}]}}',
    '{"events":[{"eventAction":"last changed","eventDate":"2026-01-01T00:00:00Z"},{"eventAction":"created","eventDate":"2026-06-23"}],"entities":[],"nameservers":[]}',
    '{"events":[{"eventAction":"expiration","eventDate":"2027-01-01"}]}',
    "not json <k>",
    f'{{"events":[{{"eventAction":"registration","eventDate":"2024-02-29T23:59:59Z"}}],"entities":[{_nested(5)}]}}',
    '{"events":[{"eventAction":"registration","eventDate":"2030-01-01"}],"entities":[{"roles":["registrant"]}]}',
)
#: By host: an origin as a list, under either name; without a number; not JSON.
ADDRESS = _case(
    4,
    f'{{"name":"HOST-<k>","originAutnums":["645<k>"],"entities":[{{"roles":["abuse"],{_card("email", "abuse@host<k>.test")}}}]}}',
    '{"name":"NET-<k>","arin_originas0_originautnumbers":["13335","1"],"originAutnums":["2"]}',
    '{"name":"PLAIN-<k>"}',
    "<html>",
)
#: By domain: names on certificates, some of the domain itself, some twice, with a wildcard.
CERTIFICATES = _case(3, '[{"name_value":"*.<key>^nsibling<k>.test"},{"name_value":"Sibling<k>.test^nother<k>.test^n*.third<k>.test"}]', '[{"name_value":"www.<key>"}]', "[]")
#: By host, of two services.
URLHAUS = _case(4, '{"query_status":"ok","url_count":"<k>","urls":["a"]}', '{"query_status":"no_results"}', '{"query_status":"ok","urls":[]}', '{"query_status":"ok","urls":["a","b"]}')
SAFE_BROWSING = _case(3, '{"matches":[{"threatType":"SOCIAL"},{"threatType":"MALWARE"},{"threatType":"SOCIAL"},{}]}', "{}", '{"matches":[{"threatType":"UNWANTED<k>"}]}')
#: By product and version: three records, of versions 3.1 and 2 and without an id; none.
_METRIC = '"metrics":{"cvssMetricV31":[{"cvssData":{"baseScore":7.5,"baseSeverity":"HIGH"}}],"cvssMetricV2":[{"baseSeverity":"LOW","cvssData":{"baseScore":1.0}}]}'
ADVISORIES = _case(
    2,
    f'{{"vulnerabilities":[{{"cve":{{"id":"CVE-A-<k>","descriptions":[{{"lang":"es","value":"x"}},{{"lang":"en","value":"of <key>"}}],{_METRIC}}}}},{{"cve":{{"id":"CVE-2021-23017","descriptions":[],"metrics":{{"cvssMetricV2":[{{"baseSeverity":"LOW","cvssData":{{"baseScore":2.1}}}}]}}}}}},{{"cve":{{"id":""}}}}]}}',
    '{"vulnerabilities":[]}',
)


def responses(keys: DataFrame, key: str, body: str) -> DataFrame:
    """(key, body) of the distinct keys in keys (scan_id, key)."""
    return keys.where(F.col(key) != "").groupBy(F.col(key).alias("key")).agg(F.min("scan_id").alias("k")).select("key", F.expr(body).alias("body"))


def responses_sql(keys: str, body: str) -> str:
    """The same over a query of (scan_id, key)."""
    return f"SELECT key, {body} AS body FROM (SELECT key, min(scan_id) AS k FROM ({keys}) GROUP BY key) WHERE key <> ''"
