"""Risk: the findings in a scan's row to bucket scores, buckets to a verdict, all within the row.

A row has hits, cves, weak and leaks (arrays of the detectors), paths (exposed paths), age (days, or null), feeds (number of
feeds that list the host) and looks (brands that it looks like). Arrays that are null mean that a scan has no capture: its
verdict is Unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import fixed_values as V

BUCKETS = tuple(V.BUCKET_CAPS)


def points(severity: Column) -> Column:
    out = F.lit(1)
    for name, value in V.SEVERITY_POINTS.items():
        out = F.when(F.lower(severity) == name, value).otherwise(out)
    return out


def age_points(days: str) -> Column:
    """Points of a domain's age in days; null for an age without points."""
    return F.coalesce(*(F.when(F.col(days) <= most, n) for most, n in V.DOMAIN_AGE_POINTS))


def decayed(weights: Column, cap: int) -> Column:
    """Weights added up, strongest first, each next one counting DECAY times less; half to even, at most cap."""
    down = F.sort_array(F.transform(weights, lambda w: F.greatest(w, F.lit(0)).cast("double")), asc=False)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("part"))
    total = F.aggregate(down, start, lambda a, w: F.struct((a["sum"] + w * a["part"]).alias("sum"), (a["part"] * V.DECAY).alias("part")), lambda a: a["sum"])
    return F.least(F.bround(F.round(total, 9)).cast("int"), F.lit(cap))


def band(score: Column) -> Column:
    out = F.lit(V.RISK_BANDS[0][1])
    for least, name in V.RISK_BANDS:
        out = F.when(score >= least, name).otherwise(out)
    return out


def filled(line: str, **values) -> Column:
    """A line whose {names} are columns."""
    parts, rest = [], line
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest)) if parts else F.lit(line)


def _weights() -> dict[str, Column]:
    rated = lambda found: F.transform(found, lambda x: points(x["severity"]))
    intel = F.concat(F.filter(F.array(age_points("age")), lambda w: w.isNotNull()), F.array_repeat(F.lit(V.FEED_POINTS), F.col("feeds").cast("int")), F.transform("looks", lambda _: F.lit(V.VISUAL_POINTS)))
    scam = F.transform("hits", lambda h: F.when(h["weight"] != 0, h["weight"]).otherwise(points(h["severity"])))
    return {"scam": scam, "cve": rated("cves"), "misconfig": rated("paths"), "posture": rated("weak"), "exposure": rated("leaks"), "intel": intel}


def with_buckets(df: DataFrame) -> DataFrame:
    """df with buckets: an array of (bucket, findings, score) of the six, in order."""
    weights = _weights()
    df = df.withColumn("weights", F.struct(*(weights[b].alias(b) for b in BUCKETS)))
    each = (F.struct(F.lit(b).alias("bucket"), F.size(f"weights.{b}").cast("bigint").alias("findings"), decayed(F.col(f"weights.{b}"), cap).alias("score")) for b, cap in V.BUCKET_CAPS.items())
    return df.withColumn("buckets", F.array(*each)).drop("weights")


def with_verdict(df: DataFrame) -> DataFrame:
    """df with risk: (score, level, contributions array, summary)."""
    df = with_buckets(df)
    at = {b: F.col("buckets")[i] for i, b in enumerate(BUCKETS)}
    bits = F.array_join(F.filter(F.array(F.when(F.col("age").isNotNull(), F.concat(F.lit("age "), "age", F.lit("d"))), F.when(F.col("feeds") > 0, "feed-listed"), F.when(F.size("looks") > 0, "visual match")), lambda x: x.isNotNull()), ", ")
    lines = (F.when(at[b]["score"] > 0, filled(V.CONTRIBUTIONS[b], n=at[b]["findings"], pts=at[b]["score"], said=bits)) for b in BUCKETS)
    count = lambda found, test: F.size(F.filter(found, test))
    real = count("cves", lambda c: c["kind"] == "cve")
    phishing = count("hits", lambda h: h["category"].isin(*V.PHISHING_CATEGORIES))
    scam = count("hits", lambda h: F.startswith(h["category"], F.lit("scam_")) | h["category"].isin(*V.SCAM_CATEGORIES))
    said = lambda name, n: F.when(n > 0, filled(V.DRIVERS[name], n=n))
    drivers = F.concat_ws(
        "; ",
        said("phishing", phishing),
        said("scam", scam),
        F.when(F.size("cves") > 0, filled(V.DRIVERS["cve"], n=F.when(real > 0, real).otherwise(F.size("cves")))),
        said("misconfig", F.size("paths")),
        said("exposure", F.size("leaks")),
        said("feed", F.col("feeds")),
        said("visual", F.size("looks")),
        F.when(F.col("age") <= V.YOUNG_DOMAIN_DAYS, filled(V.DRIVERS["age"], n=F.col("age"))),
    )
    df = df.withColumns({"score": F.least(F.lit(100), F.aggregate("buckets", F.lit(0), lambda a, b: a + b["score"])), "drivers": drivers, "known": F.col("hits").isNotNull() & F.col("cves").isNotNull() & F.col("weak").isNotNull()})
    drivers = F.when(F.col("drivers") != "", F.col("drivers")).when(F.size("weak") > 0, V.DRIVERS["posture"]).otherwise(V.DRIVERS["none"])
    level = F.when(F.col("known"), band(F.col("score"))).otherwise(V.UNKNOWN[0])
    summary = F.when(F.col("known"), filled(V.SUMMARY, level=band(F.col("score")), drivers=drivers)).otherwise(V.UNKNOWN[1])
    contributions = F.when(F.col("known"), F.filter(F.array(*lines), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    risk = F.struct(F.when(F.col("known"), F.col("score")).otherwise(0).alias("score"), level.alias("level"), contributions.alias("contributions"), summary.alias("summary"))
    return df.withColumn("risk", risk).drop("score", "drivers", "known")
