"""Hard-negative mining with a pivot table.

A vector x gets one more component, sqrt(M - x.x) with M the greatest squared length of all rows, and an anchor q gets 0, so
that their squared distance is q.q + M - 2 q.x: the higher the inner product, the nearer. A table keeps the distance of each
row to a few pivots. An anchor's distances to the pivots bracket its distance to a row by the triangle inequality, and so its
score; only rows whose bracket can matter are scored, exactly, in integers.

Rows are dealt to shards of bounded size, written once with their distances. Anchors come to each shard in a stream, sorted
behind its rows, so a task holds one shard and a batch of anchors. First the positives of each anchor are found, the best rows
of its label; then, between the bounds that each positive's score sets, the best rows of other labels. The shards' answers
are merged by score and id. Pivots are drawn from at most SAMPLE_ROWS rows; any pivots give exact answers.

Defined cases: rows with a null label, vector or vec_id, an empty vector, or a null or non-finite component take no part;
vectors meet only vectors of their length; ties go to the smaller vec_id; rows that repeat count each time, as positives with negatives of their own, but rows with an
anchor's vec_id are neither its positives nor its negatives, and of anchors that share a vec_id the least row asks; a positive
with a score below zero admits nothing; an anchor without positives or negatives has no row; scores are exact below 2**53;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import done_with, lean, materialize

POSITIVES = NEGATIVES = 5
#: A negative has at least LOW and at most HIGH hundredths of the positive's score.
LOW, HIGH = 80, 100
PIVOTS = 16
SAMPLE_ROWS = 2048
SHARD_ROWS = 1 << 13
_CHUNK = 64
_FOUND = "anchor_id bigint, id bigint, score bigint, place bigint, positive_id bigint, positive_score bigint"


def quantised(rows: DataFrame, scale: float = 256.0, label: Column | None = None) -> DataFrame:
    """(vec_id, label, v) with v the floor of scale times each component, of the rows that take part."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    used = rows.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0").where(ok)
    return used.select(F.col("vec_id").cast("long"), (F.col("label") if label is None else label).cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(column.value_lengths()).cumsum()
    return np.split(flat, ends[:-1]) if len(ends) else []


class Space:
    """Vectors of every length in the space of one more component, and the pivots there."""

    def __init__(self, most: int, sample: list[list[int]], pivots: int):
        self.most, self.pivots = float(most), {}
        by_length: dict[int, list] = {}
        for v in sample:
            by_length.setdefault(len(v), []).append(v)
        for n, vs in by_length.items():
            x = np.unique(np.array(vs, np.float64), axis=0)
            x = np.column_stack([x, self.added(x)])
            at, far = [0], np.full(len(x), np.inf)
            while len(at) < min(pivots, len(x)):  # each next pivot is the farthest from those before
                far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
                at.append(int(far.argmax()))
            self.pivots[n] = x[at]

    def added(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x**2).sum(1), 0))

    def distances(self, x: np.ndarray, added: np.ndarray) -> np.ndarray:
        """Of each vector of x, with its added component, to each pivot of its length."""
        p = self.pivots.get(x.shape[1], np.empty((0, x.shape[1] + 1)))
        squares = (x**2).sum(1)[:, None] + (added**2)[:, None] + (p**2).sum(1) - 2 * (x @ p[:, :-1].T + added[:, None] * p[:, -1])
        return np.sqrt(np.maximum(squares, 0))


def _tabled(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = _vectors(batch.column("v"))
            d: list = [None] * len(vs)
            for n in {len(v) for v in vs}:
                at = [i for i, v in enumerate(vs) if len(v) == n]
                x = np.array([vs[i] for i in at])
                for i, row in zip(at, space.distances(x, space.added(x))):
                    d[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.list_(pa.float64()))], [*batch.schema.names, "d"])

    return run


class Shard:
    """Rows of one length with their pivot distances, in order of id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, d: np.ndarray, space: Space):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x, self.d, self.space = ids[order], labels[order], x[order], d[order], space
        self.slack = 1e-6 * max(1.0, space.most)  # far above what rounding adds to a squared distance
        self.tested = 0

    def bracket(self, q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that the pivots leave to each of rows."""
        own = float(q @ q)
        if not self.d.shape[1]:
            return np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
        to = self.space.distances(q[None], np.zeros(1))[0]
        near, far = np.abs(self.d[rows] - to).max(1), (self.d[rows] + to).min(1)
        half = (own + self.space.most) / 2
        return half - far**2 / 2 - self.slack, half - near**2 / 2 + self.slack

    def best(self, q: np.ndarray, rows: np.ndarray, bands: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each band (least, greatest score): (places, scores) of the k best of rows within it; ties to smaller ids."""
        low, high = self.bracket(q, rows)
        kept = (high >= bands[:, 0].min()) & (low <= bands[:, 1].max())
        rows, high = rows[kept], high[kept]
        order = np.argsort(-high, kind="stable")
        rows, high = rows[order], high[order]
        found = [(np.empty(0, np.int64), np.empty(0))] * len(bands)
        at, step = 0, _CHUNK
        while at < len(rows):
            last = [s.min() if len(s) == k else -np.inf for _, s in found]
            if high[at] < min(last):
                break
            now = rows[at : at + step]
            score = self.x[now] @ q
            self.tested += len(now)
            for b, (least, most) in enumerate(bands):
                fits = (score >= least) & (score <= most)
                r, s = np.concatenate([found[b][0], now[fits]]), np.concatenate([found[b][1], score[fits]])
                top = np.lexsort((r, -s))[:k]  # places are in order of id
                found[b] = r[top], s[top]
            at, step = at + step, step * 2
        return found


def _shard_of(rows: list[dict], n: int, space: Space) -> Shard:
    of = lambda c: np.concatenate([r[c] for r in rows])
    return Shard(of("vec_id"), of("label"), of("v").reshape(-1, n), of("d").reshape(len(of("vec_id")), -1), space)


def _stream(space: Space, ask):
    """Rows of a shard, then its anchors: (shard, n, kind, vec_id, label, v, d or bands, ids), sorted by shard, n and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, shard = None, [], None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("shard", "n", "kind")])
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                s, n, kind = where[:, i].tolist()
                if place != (s, n):
                    place, rows, shard = (s, n), [], None
                part = batch.slice(i, j - i)
                flat = {c: part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in ("v", "d")}
                if kind == 0:
                    rows.append(flat | {c: part.column(c).to_numpy() for c in ("vec_id", "label")})
                elif rows:
                    if shard is None:
                        shard, rows = _shard_of(rows, n, space), rows[:1]
                    out: list[list] = [[], [], [], [], [], []]
                    for one in part.select(["vec_id", "label", "v", "d", "ids"]).to_pylist():
                        ask(shard, one, out)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor_id", "id", "score", "place", "positive_id", "positive_score"])

    return lean(run)


def _positives(k: int):
    def ask(shard: Shard, one: dict, out: list[list]) -> None:
        rows = np.flatnonzero((shard.labels == one["label"]) & (shard.ids != one["vec_id"]))
        ((at, score),) = shard.best(np.array(one["v"], np.float64), rows, np.array([[-np.inf, np.inf]]), k)
        for column, values in zip(out, ([one["vec_id"]] * len(at), shard.ids[at].tolist(), score.astype(np.int64).tolist(), *[[None] * len(at)] * 3)):
            column.extend(values)

    return ask


def _negatives(k: int, low: int, high: int):
    def ask(shard: Shard, one: dict, out: list[list]) -> None:
        scores = np.array(one["d"], np.float64)
        bands = np.column_stack([np.ceil(low * scores / 100), np.floor(high * scores / 100)])
        rows = np.flatnonzero((shard.labels != one["label"]) & (shard.ids != one["vec_id"]))
        for place, ((at, score), positive, said) in enumerate(zip(shard.best(np.array(one["v"], np.float64), rows, bands, k), one["ids"], one["d"])):
            for column, values in zip(out, ([one["vec_id"]] * len(at), shard.ids[at].tolist(), score.astype(np.int64).tolist(), *([x] * len(at) for x in (place, positive, int(said))))):
                column.extend(values)

    return ask


def _ranked(found: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pivots: int = PIVOTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows and anchors (vec_id, label, v)."""
    size = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    shards = max(1, -(-size[0] // shard_rows))
    sample = rows.select("v").orderBy(F.xxhash64("vec_id", "v"), "v").limit(SAMPLE_ROWS).collect()  # bounded
    space = Space(size[1] or 0, [r.v for r in sample], pivots)
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("n"), "vec_id", "label", "v")
    table = materialize(dealt.mapInArrow(_tabled(space), "shard int, n int, vec_id bigint, label bigint, v array<bigint>, d array<double>"), "pivot_table")
    asked = materialize(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.*"), "anchors")
    kept = table.select("shard", "n", F.lit(0).alias("kind"), "vec_id", "label", "v", "d", F.lit(None).cast("array<bigint>").alias("ids"))

    def over_shards(anchors: DataFrame, ask) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        came = anchors.select(each, F.size("v").alias("n"), F.lit(1).alias("kind"), "vec_id", "label", "v", "d", "ids")
        return kept.union(came).repartition(shards, "shard").sortWithinPartitions("shard", "n", "kind").mapInArrow(_stream(space, ask), _FOUND)

    none = (F.lit(None).cast("array<double>").alias("d"), F.lit(None).cast("array<bigint>").alias("ids"))
    best = _ranked(over_shards(asked.select("*", *none), _positives(positives)), ("anchor_id",), positives)
    best = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # at most `positives`
    best = materialize(best.join(asked, best["anchor_id"] == asked["vec_id"]).select("vec_id", "label", "v", F.col("p.score").cast("array<double>").alias("d"), F.col("p.id").alias("ids")), "positives")
    done_with(asked)
    found = _ranked(over_shards(best, _negatives(negatives, low, high)), ("anchor_id", "place"), negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)
    return mined(rows, rows.where("vec_id % 100 = 0"))


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, r.vec_id AS id, r.label = q.label AS same, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM r q JOIN r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id AND len(r.v) = len(q.v)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same
  QUALIFY place <= 5
), n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 80 * p.positive_score AND 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
