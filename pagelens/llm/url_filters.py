"""URL filters: rules for hosts and paths, and link-graph propagation for what no rule decides; DataFrame functions only.

Pages link hosts to hosts. Trust starts at hosts with pages that rules allow and follows links (personalised PageRank);
distrust starts at hosts with pages that rules block and goes back along links, to who links there. A host's start is the
share of its pages that rules allow, or block. Scores are in units of a start, and a host is blocked if its distrust
reaches THRESHOLD and exceeds its trust.

Defined cases: a null url, or one without ://, has empty host and path, matches no rule, and is allowed; null html has no
links; links of a host to itself don't count; rows that repeat a page_id are judged each by its own url; of rules of one
length that fit, the later one in the list wins; long html is searched whole; other columns are ignored; empty in, empty out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_or_plain

#: (host, path, verdict): for the host and all its subdomains, paths that start so. The longest rule that fits wins.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DAMPING = 0.85
THRESHOLD = 0.5
TOLERANCE = 1e-4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>\\]+)"""


def host_and_path(url: str) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(F.col(url), F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.substring_index(F.substring_index(F.substring(rest, F.length(host) + 1, F.length(rest)), "?", 1), "#", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) by the columns host and path. Rules are a parameter, few enough to be tested in turn, longest first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def propagate(starts: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of starts (host, trust0, distrust0) and distinct edges (src, dst, weight).

    What moves in a round is at most damping times what moved before, all hosts together, so the rounds end: after the
    logarithm of all starts over TOLERANCE at most."""
    edges = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("out")), "src").join(edges.groupBy("dst").agg(F.sum("weight").alias("in")), "dst")
    edges = materialize(edges.select("src", "dst", (F.col("weight") / F.col("out")).alias("down"), (F.col("weight") / F.col("in")).alias("up")), "edges")
    hosts = starts.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    base = materialize(hosts.join(starts, "host", "left").select("host", zero("trust0"), zero("distrust0")), "hosts")
    now = base.select("host", F.col("trust0").alias("trust"), F.col("distrust0").alias("distrust"))
    if edges.isEmpty():
        return now
    moved = math.inf
    while moved >= TOLERANCE:
        gives = edges.join(now, edges["src"] == now["host"]).select(F.col("dst").alias("host"), (F.col("down") * F.col("trust")).alias("t"), F.lit(0.0).alias("d"))
        back = edges.join(now, edges["dst"] == now["host"]).select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("up") * F.col("distrust")).alias("d"))
        came = gives.union(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        step = base.join(came, "host", "left").select("host", (F.col("trust0") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"), (F.col("distrust0") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"))
        step, before = materialize(step, "ranks"), now
        now = step
        moved = step.join(before.toDF("host", "t", "d"), "host").agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t")), F.abs(F.col("distrust") - F.col("d"))))).first()[0]
    return now


def judged(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, decided_by) for each row of pages (page_id, url, html)."""
    host, path = host_and_path("url")
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = rule_of(rules)
    ruled = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    share = lambda says: F.avg(F.coalesce((F.col("verdict") == says).cast("double"), F.lit(0.0)))
    starts = ruled.where("host != ''").groupBy("host").agg(share("allow").alias("trust0"), share("block").alias("distrust0"))
    links = parsed.where("host != ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), 1))).alias("dst"))
    edges = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src != dst and dst != ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    ranks = propagate(starts, edges)
    bad = materialize(ranks.where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select(F.col("host").alias("bad")), "bad")
    out = ruled.join(small_or_plain(bad), ruled["host"] == bad["bad"], "left")
    by_method = F.when(F.col("bad").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), F.when(F.col("rule").isNotNull(), "rule").otherwise("links").alias("decided_by"))


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
