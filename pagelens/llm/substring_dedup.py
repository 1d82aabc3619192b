"""Substring deduplication by super-k-mer partitioning.

Windows of k words are compared exactly. Each window's minimiser is its pair of neighbouring words with the least hash,
pairs with a long word before others; a run of consecutive windows with one minimiser (a super-k-mer) is one slice of
text. Slices go, packed and compressed, to the bucket of their minimiser, so all copies of a window meet in one bucket,
where sorting the windows finds the groups. Equal slices are settled early: all but those of the smallest doc_id are known
to repeat. Each piece of input does so before the shuffle, so a passage that a third of the corpus shares arrives once from
each piece, and a bucket does so again while it takes in pieces, so what it holds is bounded by its distinct slices.

Defined cases: null text has no words; texts with fewer than k words lose nothing; a window that repeats within one
document only stays; rows that repeat a doc_id don't remove each other's windows, and each row is judged on its own text;
a row with null doc_id is kept whole and removes nothing; a very long text is a piece of its own, cut like others; other
columns are kept, whatever their names, but for names that begin with _pl_; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buckets_for, give_back, lean, named, safe_names, small_batches, tune
from .words import Words, as_bytes, combine, row_slices, sliding_min

K = 13
_PIECE = 1_200_000
_HEAD = np.dtype([("row", "<u4"), ("word", "<u4"), ("count", "<u4")])
_ROW = np.dtype([("doc", "<i8"), ("tag", "<i8")])
_SPAN = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("end", "<u4")])
#: Bytes of slices that a bucket takes in before it settles equal ones.
_SETTLE = 32 << 20


def _encode(parts: list[np.ndarray | bytes]) -> bytes:
    """Arrays one after another, each field as a column of its own, which compresses better."""
    out = []
    for p in parts:
        b = p if isinstance(p, bytes) else b"".join(np.ascontiguousarray(p[f]).tobytes() for f in p.dtype.names)
        out += [np.uint64(len(p)).tobytes(), b]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _decode(blob: bytes) -> list[np.ndarray | bytes]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in (_ROW, _HEAD, _SPAN, None):
        n = int(np.frombuffer(data, "<u8", 1, at)[0])
        at += 8
        if kind is None:
            out.append(data[at : at + n])
            continue
        arr = np.empty(n, kind)
        for f in kind.names:
            arr[f] = np.frombuffer(data, kind[f], n, at)
            at += n * kind[f].itemsize
        out.append(arr)
    return out


def _spans(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), _SPAN)
    out["doc"], out["tag"], out["start"], out["end"] = doc, tag, first, last
    return out


def _settled(doc: np.ndarray, words: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the slices of bytes begin:end, each of a document, are equal to one of a smaller doc_id."""
    same = words.span_hash(begin, end)
    order = np.lexsort((doc, same))
    head = np.ones(len(order), bool)
    head[1:] = same[order][1:] != same[order][:-1]
    rep = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = doc[order] > doc[rep]
    view = memoryview(words.raw)
    for i in np.flatnonzero(later):  # equal hashes are taken for equal slices only if they are
        a, b = order[i], rep[i]
        later[i] = view[begin[a] : end[a]] == view[begin[b] : end[b]]
    out = np.zeros(len(order), bool)
    out[order[later]] = True
    return out


def _slices(doc: np.ndarray, tag: np.ndarray, words: Words, k: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed slices) of a piece of input."""
    if len(words) < k:
        return
    h = words.span_hash(words.starts, words.ends)  # only deals windows to buckets: what meets there is compared
    short = words.ends - words.starts <= 4
    key = (combine(h, np.arange(len(h) - 1), 2) >> np.uint64(1)) | ((short[1:] & short[:-1]).astype(np.uint64) << np.uint64(63))
    at = words.window_starts(k)
    if not len(at):
        return
    least = sliding_min(key, k - 1)[at]
    row = np.repeat(np.arange(len(doc)), np.diff(words.offsets))[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    w0, row, least = at[first], row[first], least[first]
    count = n + k - 1
    b0, b1 = words.starts[w0], words.ends[w0 + count - 1]
    settled, view = _settled(doc[row], words, b0, b1), memoryview(words.raw)
    word = w0 - words.offsets[row]
    bucket = ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(bucket[order].astype(np.int64)) != 0))
    for lo, hi in zip(edges, np.append(edges[1:], len(order))):
        mine = order[lo:hi]
        gone = mine[settled[mine]]
        spans = _spans(doc[row[gone]], tag[row[gone]], word[gone], word[gone] + count[gone])
        mine = mine[~settled[mine]]
        rows, index = np.unique(row[mine], return_inverse=True)
        heads, owners = np.empty(len(mine), _HEAD), np.empty(len(rows), _ROW)
        heads["row"], heads["word"], heads["count"] = index, word[mine], count[mine]
        owners["doc"], owners["tag"] = doc[rows], tag[rows]
        text = b"".join([view[s:e] for s, e in zip(b0[mine].tolist(), (b1[mine] + 1).tolist())])
        yield int(bucket[mine[0] if len(mine) else gone[0]]), _encode([owners, heads, spans, text])


def _deal(k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_slices(batch.column(1), _PIECE):
                docs = as_bytes(batch.column(1).slice(lo, hi - lo))
                ids = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
                tags = np.array([xxhash.xxh64_intdigest(d, seed=42) for d in docs], np.uint64).view(np.int64)
                out = list(_slices(ids, tags, Words(docs), k, buckets))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "slices"])

    return run


def _order_windows(ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows in an order that puts equal ones together, and where each group starts. Exact: ids are compared."""
    key = combine(ids, at, k)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    del key
    twin = np.flatnonzero(~new)
    a, b = at[order[twin]], at[order[twin - 1]]
    if any((ids[a + j] != ids[b + j]).any() for j in range(k)):  # two windows with one hash: sort by the ids themselves
        order = np.lexsort([ids[at + j] for j in range(k)])
        new[1:] = np.logical_or.reduce([ids[at[order[1:]] + j] != ids[at[order[:-1]] + j] for j in range(k)])
    return order, new


class _Bucket:
    """The slices of a bucket, taken in blob by blob."""

    def __init__(self):
        self.owners, self.heads, self.texts, self.found = [], [], [], []
        self.rows, self.size, self.limit = 0, 0, _SETTLE

    def add(self, blob: bytes) -> None:
        r, h, s, t = _decode(blob)
        h["row"] += np.uint32(self.rows)
        self.rows += len(r)
        self.owners.append(r), self.heads.append(h), self.texts.append(t)
        if len(s):
            self.found.append(s)
        self.size += len(t)
        if self.size > self.limit:
            self.settle()

    def whole(self) -> tuple[np.ndarray, np.ndarray, Words]:
        """All that it holds, which it gives away."""
        owners, heads, text = np.concatenate(self.owners), np.concatenate(self.heads), b"".join(self.texts)
        for held in (self.owners, self.heads, self.texts):
            held.clear()
        return owners, heads, Words.packed(text, heads["count"])

    def settle(self) -> None:
        owners, heads, words = self.whole()
        begin, end = words.starts[words.offsets[:-1]], words.ends[words.offsets[1:] - 1]
        gone = _settled(owners["doc"][heads["row"]], words, begin, end)
        h = heads[gone]
        self.found = [np.unique(np.concatenate([*self.found, _spans(owners["doc"][h["row"]], owners["tag"][h["row"]], h["word"], h["word"] + h["count"])]))]
        view = memoryview(words.raw)
        left = b"".join([view[b:e] for b, e in zip(begin[~gone].tolist(), (end[~gone] + 1).tolist())])
        used, heads = np.unique(heads["row"][~gone], return_inverse=True), heads[~gone]
        heads["row"] = used[1]
        self.owners, self.heads, self.texts, self.rows, self.size = [owners[used[0]]], [heads], [left], len(used[0]), len(left)
        self.limit = max(_SETTLE, 2 * self.size)


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tune()
        bucket = _Bucket()
        for batch in batches:
            for blob in batch.column(batch.schema.get_field_index("slices")).to_pylist():
                bucket.add(blob)
        owners, heads, words = bucket.whole()
        found = bucket.found
        del bucket
        if len(heads):
            ids, at, offsets = words.ids(), words.window_starts(k), words.offsets
            if len(ids) < 1 << 31:
                at = at.astype(np.int32)
            del words
            give_back()
            order, new = _order_windows(ids, at, k)
            del ids
            starts = np.flatnonzero(new)
            piece = np.repeat(np.arange(len(heads), dtype=np.int32), heads["count"])[at]
            doc = np.unique(owners["doc"], return_inverse=True)[1].astype(np.int32)[heads["row"]][piece][order]  # in the order of doc_ids
            least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(order))))
            hit = np.sort(order[doc > least])
            del order, new, starts, doc, least
            if len(hit):
                p = piece[hit]
                w = (at[hit] - offsets[p]).astype(np.uint32)
                cut = np.append(True, (p[1:] != p[:-1]) | (w[1:] != w[:-1] + 1))
                first = np.flatnonzero(cut)
                last = np.append(first[1:], len(hit)) - 1
                h = heads[p[first]]
                found.append(_spans(owners["doc"][h["row"]], owners["tag"][h["row"]], h["word"] + w[first], h["word"] + w[last] + k))
        out = np.concatenate(found) if found else np.empty(0, _SPAN)
        order = np.lexsort((out["start"], out["tag"], out["doc"]))
        out = out[order]
        new = np.append(True, (out["doc"][1:] != out["doc"][:-1]) | (out["tag"][1:] != out["tag"][:-1]))[: len(out)]
        first = np.flatnonzero(new)
        off = pa.array(np.append(first, len(out)), pa.int32())
        lists = [pa.ListArray.from_arrays(off, pa.array(out[f].astype(np.int32))) for f in ("start", "end")]
        yield pa.RecordBatch.from_arrays([pa.array(out["doc"][first]), pa.array(out["tag"][first]), *lists], ["_pl_doc", "_pl_tag", "_pl_start", "_pl_end"])
        give_back()

    return run


def repeated_spans(docs: DataFrame, k: int = K) -> DataFrame:
    """Word spans [_pl_start, _pl_end) of each text that windows also starting under a smaller doc_id cover."""
    small_batches(docs.sparkSession)
    buckets = buckets_for(docs.select("doc_id", "text"), 2 << 20)
    dealt = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(lean(_deal(k, buckets)), "bucket int, slices binary")
    return dealt.groupBy("bucket").applyInArrow(_count(k), "_pl_doc bigint, _pl_tag bigint, _pl_start array<int>, _pl_end array<int>")


def _cut(names: list[str], text_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, s, e = (batch.column(batch.schema.get_field_index(c)) for c in (text_name, "_pl_starts", "_pl_ends"))
            kept, total, gone = [], [], []
            for t, first, last in zip(as_bytes(text), s.to_pylist(), e.to_pylist()):
                words = t.split()
                n = len(words)
                if first:
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, np.concatenate([np.asarray(x, np.int64) for x in first]), 1)
                    np.add.at(edge, np.concatenate([np.asarray(x, np.int64) for x in last]), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                kept.append(b" ".join(words))
                total.append(n)
                gone.append(n - len(words))
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            cols |= {"_pl_kept": pa.array(kept, pa.binary()).cast(pa.string()), "_pl_words": pa.array(total, pa.int64()), "_pl_gone": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def dedup(docs: DataFrame, k: int = K) -> DataFrame:
    """docs with the columns _pl_kept (kept words joined by one space), _pl_words and _pl_gone (words, words removed)."""
    spans = repeated_spans(docs, k).groupBy("_pl_doc", "_pl_tag").agg(F.collect_list("_pl_start").alias("_pl_starts"), F.collect_list("_pl_end").alias("_pl_ends"))
    tagged = docs.withColumn("_pl_key", F.xxhash64("text"))
    both = tagged.join(spans, (F.col("doc_id") == F.col("_pl_doc")) & (F.col("_pl_key") == F.col("_pl_tag")), "left").drop("_pl_doc", "_pl_tag", "_pl_key")
    safe = safe_names(docs.columns)
    both = both.select(*(c.alias(n) for c, n in zip(named(docs.columns), safe.values())), "_pl_starts", "_pl_ends")
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(safe.values(), docs.schema.fields)]).add("_pl_kept", "string").add("_pl_words", "long").add("_pl_gone", "long")
    out = both.mapInArrow(lean(_cut(list(safe.values()), safe["text"])), schema)
    return out.select(*(F.col(n).alias(c) for c, n in safe.items()), "_pl_kept", "_pl_words", "_pl_gone")


def strip_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """The columns of docs, the text without what repeats, n_chars (if there) brought up to date."""
    out = dedup(docs, k).withColumn("text", F.when(F.col("text").isNotNull(), F.col("_pl_kept")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*named(docs.columns))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", F.col("_pl_words").alias("n_words"), F.col("_pl_gone").alias("n_removed"), F.sha2("_pl_kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT r, doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word, ws FROM d),
win AS (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY array_to_string(ws[i:i + 12], ' ')) AS gone FROM w WHERE doc_id IS NOT NULL AND i + 12 <= len(ws)),
cut AS (SELECT DISTINCT r, i + unnest(range(13)) AS i FROM win WHERE gone),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS said, count(*) AS n FROM w ANTI JOIN cut USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
