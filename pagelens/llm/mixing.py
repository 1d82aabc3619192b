"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's documents all have the same expected number of copies, its target over its size. The fractional parts are
rounded in pairs: words move from one document's expectation to the other's, by as much as makes one of them whole, in a
random direction with the odds that keep both expectations. A pair's words stay the same in sum, so only the last document
of a source changes its total. Documents are folded in random groups of about GROUP, long ones first, so that what is left
is short; it goes to the next level of a tree of that arity, until one document of the source is left.

Draws are hashes of the seed and the pair, so reruns agree. Equal rows are one unit with a count: a row that repeats
without bound makes no large group. Targets are worked out on the table of sources, which is ranked and summed in
parts, so that a source for each host of a crawl is no more than another table.

Defined cases: null text has size 0; documents of size 0 take nothing; sources order by code point, null last; a null doc_id
is a document like others; a very long text is a unit like others, its size all that is kept; units of one size are in
order of their hash; columns may have any names (mixed keeps them, copies ignores them); maps don't tell rows apart; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, named, small_or_plain

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
GROUP = 64
SEED = 29


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(per: DataFrame) -> DataFrame:
    """per (source, ...) with turn, the place of its source from 0 on: places within sorted ranges, after those before."""
    ranges = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("source").asc_nulls_last()
    placed = materialize(per.repartitionByRange(ranges, by).sortWithinPartitions(by).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each range
    sizes = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(sizes), part == F.col("part")).withColumn("turn", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "before")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, units, target) of sizes (source, size): shares of the whole by weight, none above the cap.

    The level of a weight of 1 rises as sources reach their cap, until none above it is left."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    per = _ranked(per).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("turn", F.lit(len(WEIGHTS))) + 1).cast("int")))
    per = materialize(per, "weights")
    cap, level, before = MOST_COPIES * F.col("source_size"), 0.0, None
    while level != before:
        full = cap <= F.lit(level) * F.col("weight")
        whole, kept, weight = per.agg(F.sum("source_size"), F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        before, level = level, (whole - kept) / weight if weight else level
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    return per.select("source", "source_size", "units", target.alias("target"))


def _draw(seed: int, *cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def _fold(units: Column, seed: int) -> Column:
    """Pivotal rounding along an array of units: (rest, the unit that is left; done, the rounded ones)."""

    def unit(u: Column, p: Column) -> Column:
        return F.struct(*(u[c].alias(c) for c in ("key", "doc_id", "size", "rows", "base")), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["rest"]
        up = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])
        down = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])
        go = _draw(seed, a["key"], x["key"], a["p"]) * (up + down) < down
        a_ends = F.when(go, (1 - a["p"]) * a["size"] <= x["p"] * x["size"]).otherwise(a["p"] * a["size"] <= (1 - x["p"]) * x["size"])
        moved = F.when(go, up).otherwise(-down)
        in_range = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        ended = F.when(a_ends, unit(a, F.when(go, 1.0).otherwise(0.0))).otherwise(unit(x, F.when(go, 0.0).otherwise(1.0)))
        rest = F.when(a_ends, unit(x, in_range(x["p"] - moved / x["size"]))).otherwise(unit(a, in_range(a["p"] + moved / a["size"])))
        return F.struct(rest.alias("rest"), F.concat(acc["done"], F.array(ended)).alias("done"))

    first = F.struct(unit(units[0], units[0]["p"]).alias("rest"), F.slice(units, 1, 0).alias("done"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(1))), first, step)


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(*named([c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]))


def copies(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """A row for each row of docs (doc_id, text, source): key, doc_id, size, source_size, target, copies.

    key is a hash of the whole row; equal rows have equal keys."""
    sized = docs.select(_key(docs).alias("key"), F.col("doc_id").cast("long"), "source", word_count("text").alias("size"))
    units = materialize(sized.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("rows")), "units")
    targets = materialize(source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size"))), "targets")
    join = lambda left: left.join(small_or_plain(targets), left["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    share = F.when(F.col("size") > 0, F.col("target") / F.col("source_size") * F.col("rows")).otherwise(0.0)
    units = join(units).withColumn("base", F.floor(share)).withColumn("p", share - F.floor(share))
    most = targets.agg(F.max("units")).first()[0] or 1
    struct = F.struct("key", "doc_id", "size", "rows", "base", "p")
    buckets = F.ceil(F.col("units") / GROUP)
    open_ = units.where("p > 0").select("source", F.pmod(F.xxhash64(F.lit(seed), "key", "doc_id"), buckets).alias("bucket"), struct.alias("unit"))
    done = [units.where("p <= 0").select("source", struct.alias("unit"))]
    groups, level = -(-most // GROUP), 0
    while True:
        order = F.struct((-F.col("unit.size")).alias("s"), F.col("unit.key").alias("k"), "unit")
        sorted_ = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["unit"])
        folded = open_.groupBy("source", "bucket").agg(sorted_.alias("units")).select("source", "bucket", _fold(F.col("units"), seed + level).alias("f"))
        folded = materialize(folded.select("source", "bucket", "f.*"), "fold")
        done.append(folded.select("source", F.explode("done").alias("unit")))
        if groups <= 1:
            break
        open_ = folded.select("source", F.floor(F.col("bucket") / GROUP).alias("bucket"), F.col("rest").alias("unit"))
        groups, level = -(-groups // GROUP), level + 1
    last = F.col("rest").withField("p", F.when(_draw(seed, F.col("rest.key"), F.lit(-1)) < F.col("rest.p"), 1.0).otherwise(0.0))
    done.append(folded.select("source", last.alias("unit")))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    out = out.select("source", "unit.*").withColumn("total", (F.col("base") + F.round("p")).cast("long"))
    out = out.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    each = F.floor(F.col("total") / F.col("rows")) + (F.col("turn") <= F.col("total") % F.col("rows")).cast("long")
    return join(out).select("key", "doc_id", "size", "source_size", "target", each.alias("copies"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs, each row as often as the mix takes it. Documents without words stay once."""
    keyed = docs.select(_key(docs).alias("key"), F.struct(*named(docs.columns)).alias("row"))
    taken = copies(docs, seed).groupBy("key").agg(F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(1)).alias("copies"), F.count("*").alias("rows"))
    rows = keyed.join(taken.where("copies > 0"), "key")
    # equal rows share a key: the mix's copies of them all come from one of them
    once = rows.where("rows = 1").unionByName(rows.where("rows > 1").dropDuplicates(["key"]))
    return once.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    out = copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
