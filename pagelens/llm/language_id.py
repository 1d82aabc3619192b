"""Language identification by Bayesian evidence fusion.

posterior(l) ~ text(l) * declared(l) * prior(l | host)

text: hashed byte-trigram likelihood, trained on a sample of about SAMPLE_ROWS labelled rows in equal shares for each
language, LEAST_ROWS of it or all it has at least, its weight limited to EVIDENCE trigrams, since neighbouring trigrams
repeat each other. declared: the language that markup in the text
declares, right with probability DECLARED_RIGHT. prior: shares of languages among a host's other documents, smoothed
towards those of its address suffix, and these towards all documents'; the counts are sums of posteriors without a prior
over all documents, by grouped aggregation, and a document's own is taken out of each level before it is judged, so that
no evidence counts twice. documents have a source for a host, pages their url's host; without a dot it has no suffix.

A document is rejected if it has no letters or its best posterior is under LEAST. Defined cases: null or empty text has
language null and is rejected; null source has the prior of all documents; a very long text is a piece of its own; of
languages that tie the first by name is taken; other columns are kept, whatever their names, but for names that begin with
_pl_; without any labelled row no language is known, and
documents with letters are kept with language null; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, lean, materialize, named, safe_names, small_batches, small_or_plain
from .words import as_bytes, row_slices

SAMPLE_ROWS = 20_000
LEAST_ROWS = 64
EVIDENCE = 50
DECLARED_RIGHT = 0.95
PULL = 20.0
LEAST = 0.5
_BITS = 14
_PIECE = 1 << 19
#: Cells of the score matrix of a piece, and languages that a task counts before it sends them on.
_SCORES = 1 << 21
_HELD = 256
_TAG = re.compile(rb"<(?:html|body|meta)\b[^>]*", re.I)
_MARKUP = re.compile(rb"""\b(?:xml:)?(?:lang|content-language)["']?\s*(?:=|content=)\s*["']?([a-zA-Z]{2,3})\b""", re.I)
_LETTER = np.array([chr(c).isalpha() if c < 128 else True for c in range(256)])


def _grams(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells of all trigrams, where each doc begins and the last ends, letters of each doc)."""
    size = np.array([len(d) for d in docs], np.int64)
    bounds = np.append(0, np.cumsum(size + 2))
    buf = np.frombuffer(b"  ".join(docs).lower() + b"  ", np.uint8)
    x = buf.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    letters = np.append(0, np.cumsum(_LETTER[buf]))
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - _BITS)).astype(np.int32), bounds, letters[bounds[1:]] - letters[bounds[:-1]]


def _slices(texts: pa.Array, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose scores by n languages are few enough to be held."""
    step = max(1, _SCORES // max(n, 1))
    for lo, hi in row_slices(texts, _PIECE):
        yield from ((i, min(i + step, hi)) for i in range(lo, hi, step))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells: dict[str, np.ndarray] = {}

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(cells), pa.string()), pa.array([c.astype("<i8").tobytes() for c in cells.values()], pa.binary())], ["lang", "cells"])
        cells.clear()
        return out

    for batch in batches:
        for lo, hi in row_slices(batch.column(1), _PIECE):
            gram, bounds, _ = _grams(as_bytes(batch.column(1).slice(lo, hi - lo)))
            for i, lang in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                cells[lang] = cells.get(lang, 0) + np.bincount(gram[bounds[i] : bounds[i + 1] - 2], minlength=1 << _BITS)
                if len(cells) >= _HELD:
                    yield sent()
    yield sent()


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: np.ndarray | int = 0
    for batch in batches:
        lang = batch.column(batch.schema.get_field_index("lang"))[:1]
        for cells in batch.column(batch.schema.get_field_index("cells")):
            total = total + np.frombuffer(cells.as_py(), "<i8")
    yield pa.RecordBatch.from_arrays([lang, pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["lang", "cells"])


def _quota(counts: list[int], rows: int) -> float:
    """Rows of each language so that all together are rows, those that have fewer giving what they have."""
    left = float(rows)
    for i, n in enumerate(sorted(counts)):
        if n * (len(counts) - i) > left:
            return max(left / (len(counts) - i), LEAST_ROWS)
        left -= n
    return math.inf


def sampled(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, text) of about that many of labelled (doc_id, text, lang); the row of least hash of each language is one."""
    known = labelled.where("lang is not null and text is not null").select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).alias("spot"))
    per = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("spot").alias("least")).collect()
    quota = _quota([r["n"] for r in per], rows)
    if quota == math.inf:
        return known.select("lang", "text")
    cuts = [(r["lang"], max(r["least"], int(min(1.0, quota / r["n"]) * (1 << 53)))) for r in per]
    cuts = small_or_plain(labelled.sparkSession.createDataFrame(cuts, "lang string, cut bigint"))
    return known.join(cuts, "lang").where("spot <= cut").select("lang", "text")


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood table) from a sample of about that many of labelled (doc_id, text, lang)."""
    counted = sampled(labelled, rows).mapInArrow(lean(_count), "lang string, cells binary").groupBy("lang").applyInArrow(_sum, "lang string, cells binary")
    got = sorted(counted.collect(), key=lambda r: r["lang"])
    table = np.zeros((1 << _BITS, len(got)))
    for i, r in enumerate(got):
        c = np.frombuffer(zlib.decompress(r["cells"]), "<i8") + 0.5
        table[:, i] = np.log(c / c.sum())
    return [r["lang"] for r in got], table


def _declared(doc: bytes, place: dict[str, int]) -> int:
    if b"<" in doc:
        for tag in _TAG.finditer(doc):
            if found := _MARKUP.search(doc, *tag.span()):
                return place.get(found[1].decode().lower(), -1)
    return -1


def _evidence(docs: list[bytes], langs: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log evidence by language, declared language or -1, letters) of each doc."""
    gram, bounds, letters = _grams(docs)
    n = np.maximum(bounds[1:] - bounds[:-1] - 2, 0)
    ends = np.minimum(bounds[:-1] + n, len(gram))
    log = np.empty((len(docs), len(langs)))
    for i in range(len(langs)):
        run = np.append(0.0, np.cumsum(table[:, i][gram]))
        log[:, i] = (run[ends] - run[bounds[:-1]]) / np.maximum(n, 1) * np.minimum(n, EVIDENCE)
    place = {lang: i for i, lang in enumerate(langs)}
    said = np.array([_declared(d, place) for d in docs], np.int64)
    at = np.flatnonzero(said >= 0)
    if len(langs) > 1:
        log[at] += np.log((1 - DECLARED_RIGHT) / (len(langs) - 1))
        log[at, said[at]] += np.log(DECLARED_RIGHT) - np.log((1 - DECLARED_RIGHT) / (len(langs) - 1))
    return log, said, letters


def _shares(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _soft_counts(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        for batch in batches:
            for lo, hi in _slices(batch.column(1), len(langs)):
                log, _, letters = _evidence(as_bytes(batch.column(1).slice(lo, hi - lo)), langs, table)
                post = np.where(letters[:, None] > 0, _shares(log), 0.0)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * len(langs)), pa.array(post.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), flat], ["host", "post"])

    return run


def _few(n: int) -> int:
    """Rows of n numbers that may be broadcast."""
    return max(1, BROADCAST_ROWS * 256 // max(n, 256))


def _summed(df: DataFrame, by: str) -> DataFrame:
    """(by, post): the arrays post added up, for any number of languages."""
    each = df.select(by, F.posexplode("post").alias("pos", "p")).groupBy(by, "pos").agg(F.sum("p").alias("s"))
    return each.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("s")).select(by, F.col("s.s").alias("post"))


def host_counts(docs: DataFrame, host: str, model: Broadcast) -> tuple[DataFrame, np.ndarray]:
    """((host, of_host, of_suffix), counts of all): soft counts of languages among documents."""
    n = len(model.value[0])
    soft = docs.where("text is not null").select(F.col(host).alias("host"), "text").mapInArrow(lean(_soft_counts(model)), "host string, post array<double>")
    per = materialize(_summed(soft, "host"), "hosts")
    total = {r["pos"]: r["s"] for r in per.select(F.posexplode("post").alias("pos", "p")).groupBy("pos").agg(F.sum("p").alias("s")).collect()}
    suffix = F.when(F.instr("host", ".") > 0, F.lower(F.element_at(F.split("host", r"\."), -1))).otherwise("")
    per = per.where("host is not null").select("host", F.col("post").alias("of_host"), suffix.alias("suffix"))
    by = _summed(per.withColumnRenamed("of_host", "post"), "suffix").withColumnRenamed("post", "of_suffix")
    both = per.join(small_or_plain(materialize(by, "suffixes"), _few(n)), "suffix")
    return materialize(both.select("host", "of_host", "of_suffix"), "priors"), np.array([total.get(i, 0.0) for i in range(n)])


def _priors(own: np.ndarray, of_host: list, of_suffix: list, of_all: np.ndarray) -> np.ndarray:
    """Of each document, shares of languages among the others of its host, pulled towards its suffix and all."""
    less = lambda counts: np.maximum(counts - own, 0.0)
    shares = lambda counts, pull, towards: (counts + pull * towards) / (counts.sum(axis=1, keepdims=True) + pull)
    n = own.shape[1]
    out = shares(less(of_all), n, np.full(own.shape, 1 / n))
    at = np.array([i for i, x in enumerate(of_host) if x is not None], np.int64)
    if len(at):
        for counts in (of_suffix, of_host):
            out[at] = shares(np.maximum(np.array([counts[i] for i in at]) - own[at], 0.0), PULL, out[at])
    return out


def _decide(names: list[str], text_name: str, model: Broadcast, of_all: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_name))
            for lo, hi in _slices(text, len(langs)):
                log, said, letters = _evidence(as_bytes(text.slice(lo, hi - lo)), langs, table)
                part = batch.slice(lo, hi - lo)
                lang, sure, ok = [None] * (hi - lo), [0.0] * (hi - lo), letters > 0
                if langs:
                    own = np.where(letters[:, None] > 0, _shares(log), 0.0)
                    post = _shares(log + np.log(_priors(own, *(part.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_pl_host", "_pl_suffix")), of_all)))
                    best = post.argmax(axis=1)
                    top = post[np.arange(hi - lo), best]
                    lang = [langs[b] if k else None for b, k in zip(best, ok)]
                    sure = [round(float(t), 6) if k else 0.0 for t, k in zip(top, ok)]
                    ok = ok & (top >= least)
                cols = {c: part.column(batch.schema.get_field_index(c)) for c in names}
                cols |= {"_pl_lang": pa.array(lang, pa.string()), "_pl_sure": pa.array(sure, pa.float64()), "_pl_said": pa.array([langs[s] if s >= 0 else None for s in said], pa.string()), "_pl_ok": pa.array(ok.tolist(), pa.bool_())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def identified(docs: DataFrame, host: str = "source", least: float = LEAST, keep_text: bool = True) -> DataFrame:
    """docs with _pl_lang, _pl_sure (its posterior), _pl_said (declared in markup) and _pl_ok (accepted)."""
    small_batches(docs.sparkSession)
    langs, table = train(docs.select("doc_id", "text", "lang"))
    model = docs.sparkSession.sparkContext.broadcast((langs, table))
    kept = docs.columns if keep_text else [c for c in docs.columns if c != "text"]
    safe = safe_names(docs.columns)
    schema = T.StructType([T.StructField(safe[c], docs.schema[c].dataType) for c in kept]).add("_pl_lang", "string").add("_pl_sure", "double").add("_pl_said", "string").add("_pl_ok", "boolean")
    of_all, plain = np.zeros(len(langs)), [c.alias(n) for c, n in zip(named(docs.columns), safe.values())]
    if langs:
        counts, of_all = host_counts(docs, host, model)
        counts = small_or_plain(counts.select(F.col("host").alias("_pl_key"), F.col("of_host").alias("_pl_host"), F.col("of_suffix").alias("_pl_suffix")), _few(2 * len(langs)))
        docs = docs.join(counts, docs[host] == counts["_pl_key"], "left")
        plain += ["_pl_host", "_pl_suffix"]
    out = docs.select(*plain).mapInArrow(lean(_decide([safe[c] for c in kept], safe["text"], model, of_all, least)), schema)
    return out.select(*(F.col(safe[c]).alias(c) for c in kept), "_pl_lang", "_pl_sure", "_pl_said", "_pl_ok")


def accepted(docs: DataFrame) -> DataFrame:
    """docs without the rejected ones."""
    return identified(docs).where("_pl_ok").select(*named(docs.columns))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return identified(docs, keep_text=False).select("doc_id", F.col("_pl_lang").alias("language"), F.col("_pl_sure").alias("posterior"), F.col("_pl_said").alias("declared"), F.col("_pl_ok").alias("accepted"))
