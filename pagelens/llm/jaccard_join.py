"""Exact Jaccard join of word n-gram sets, with set-relation skipping, and the components of its links.

1. A fixed-size table of counts orders all shingles, rare ones first. Any order gives right results; this one keeps
   what many texts share out of the index. Sets that can link share a shingle among their first n - ceil(t * n) + 1 ones.
2. Those shingles are index entries, dealt to buckets as packed arrays. A list of the index is sorted by set size, so the
   block of partners that a set's size allows is found by search and the rest of the list is skipped whole; within a block,
   an entry's position skips pairs whose rest can't reach the overlap.
3. Equal sets have one entry. In a long list a block of sizes has a leader, the member with the least hash, so that the lists
   of a group of copies agree on it. The leader's answers are computed first, and members take theirs from it: those that
   link with one leader are in one component and need no answers among each other.
4. What lists leave open, members in different components, is compared in cells of bounded size by sketches, parities of
   fixed parts of a set, which bound the difference of two sets from below. Of the pairs a cell can't rule out it asks for
   a spanning forest first, since each answer settles those of all sets that it connects; only where an answer of the
   forest is no, the other pairs are asked for as well.
5. Candidates are confirmed on the texts. No link that joins two components is lost; linked_pairs gives all links.

Sets are of 59-bit hashes of word windows, made of 64-bit hashes of words. Defined cases: A-Z are lower-cased; a text with fewer than k words has its whole
sequence as its one shingle; null or no words: an empty set, which links with nothing; rows that share a doc_id are one
document, linked with what either links to; a null doc_id links with nothing and has component null; an empty table
gives an empty result; a very long text is a set like others, in a piece of its own; other columns are ignored (kept by
keep_one_of_each, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, done_with, input_bytes, lean, materialize, small_batches, small_or_plain
from .components import components, merged
from .words import Words, as_bytes, combine, mix, row_slices

WORDS, PERCENT = 5, 80
LONG_LIST = 16
#: So many rows of two integers may be broadcast.
NARROW_ROWS = 200_000
_PIECE = 1_000_000
_ROWS = np.dtype([("doc", "<i8"), ("n", "<u4"), ("whole", "<u8")])
_POSTS = np.dtype([("token", "<u8"), ("row", "<u4"), ("at", "<u4")])
#: Members of a list that one cell takes from each side.
CELL = 1024
#: Packed entries of a bucket that one task takes; a bucket with more is split by pieces of input.
BUCKET_BYTES = 24 << 20
_FOUND = "kind int, a bigint, b bigint, token bigint, n bigint, at bigint"


def shingles(docs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the shingles of all docs, repeats included."""
    words = Words([d.lower() for d in docs])
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = words.window_starts(k)
    rows = np.repeat(np.arange(len(docs)), np.diff(words.offsets))[at]
    n = np.diff(words.offsets)
    short = np.flatnonzero((n > 0) & (n < k))
    h, whole = words.hashes(), np.empty(len(short), np.uint64)
    for m in range(1, k):
        of = n[short] == m
        whole[of] = combine(h, words.offsets[short[of]], m)
    return np.concatenate([rows, short]), np.concatenate([combine(h, at, k), whole])


def _tally(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for lo, hi in row_slices(batch.column(0), _PIECE):
                _, key = shingles(as_bytes(batch.column(0).slice(lo, hi - lo)), k)
                cells += np.bincount((key >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        if cells.any():
            parts = [zstandard.ZstdCompressor(level=1).compress(p.tobytes()) for p in np.split(cells, 64)]
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array(parts, pa.binary())], ["part", "cells"])

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part of the table, the sums of what tasks counted, taken in one by one."""
    sums: np.ndarray | int = 0
    for batch in batches:
        part = batch.column(batch.schema.get_field_index("part"))[:1]
        for blob in batch.column(batch.schema.get_field_index("cells")):
            sums = sums + np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint32).astype(np.uint64)
    levels = np.ceil(np.log2(sums.astype(np.float64) + 1)).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([part, pa.array([levels.tobytes()], pa.binary())], ["part", "levels"])


def shingle_levels(docs: DataFrame, k: int) -> np.ndarray:
    """How common shingles are, as the logarithm of a count for each leading part of a hash.

    At most 2**24 cells of one byte, whatever the input: all that is sent to the driver and back to the executors."""
    bits = min(24, max(16, (input_bytes(docs) // 128).bit_length()))
    out = np.zeros(1 << bits, np.uint8)
    tallied = docs.select("text").where("text is not null").mapInArrow(lean(_tally(k, bits)), "part int, cells binary")
    for part, levels in tallied.groupBy("part").applyInArrow(_total, "part int, levels binary").collect():
        out[part * (len(out) // 64) : (part + 1) * (len(out) // 64)] = np.frombuffer(levels, np.uint8)
    return out


def ordered_sets(docs: list[bytes], k: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the distinct shingles of all docs by row, rare ones first."""
    row, key = shingles(docs, k)
    level = np.minimum(levels[(key >> np.uint64(64 - (len(levels).bit_length() - 1))).astype(np.int64)], 31).astype(np.uint64)
    token = (level << np.uint64(59)) | (key >> np.uint64(5))
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.append(True, (row[1:] != row[:-1]) | (token[1:] != token[:-1]))[: len(row)]
    return row[new], token[new]


def _blob(rows: np.ndarray, posts: np.ndarray) -> bytes:
    cols = [np.ascontiguousarray(a[f]).tobytes() for a in (rows, posts) for f in a.dtype.names]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(rows), len(posts)], "<u8").tobytes() + b"".join(cols))


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 16, []
    for n, kind in zip(np.frombuffer(data, "<u8", 2), (_ROWS, _POSTS)):
        arr = np.empty(int(n), kind)
        for f in kind.names:
            arr[f] = np.frombuffer(data, kind[f], int(n), at)
            at += int(n) * kind[f].itemsize
        out.append(arr)
    return tuple(out)


def _same_sets(rows: np.ndarray) -> np.ndarray:
    """For each row the row with the smallest doc of those with its set."""
    order = np.lexsort((rows["doc"], rows["n"], rows["whole"]))
    new = np.append(True, (rows["whole"][order][1:] != rows["whole"][order][:-1]) | (rows["n"][order][1:] != rows["n"][order][:-1]))[: len(order)]
    out = np.empty(len(rows), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out


def _sketches(token: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """Of each set, whether each of its parts has an odd number of shingles; a power of two of them, at least two a shingle.
    Sketches differ in no more places than the sets do, also when the longer one's halves are laid together."""
    spot, out = mix(token), []
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        places = 1 << max(6, (2 * (j - i) - 1).bit_length())
        odd = np.bincount((spot[i:j] & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
        out.append(np.packbits(odd == 1).tobytes())
    return out


def _index(k: int, percent: int, buckets: int, levels: Broadcast):
    """Rows of kind 0: a text's doc_id, size and sketch; 1: two documents with equal sets; 2: a bucket's packed entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_slices(batch.column(1), _PIECE):
                row, token = ordered_sets(as_bytes(batch.column(1).slice(lo, hi - lo)), k, levels.value)
                ids = batch.column(0).slice(lo, hi - lo)
                rows = np.zeros(hi - lo, _ROWS)
                rows["doc"], rows["n"] = ids.fill_null(0).to_numpy(zero_copy_only=False), np.bincount(row, minlength=hi - lo)
                full = np.flatnonzero(rows["n"])
                rows["whole"][full] = np.add.reduceat(mix(token), np.flatnonzero(np.append(True, np.diff(row) != 0))) if len(full) else 0
                out = {"kind": [np.zeros(hi - lo, np.int32)], "a": [rows["doc"]], "n": [rows["n"].astype(np.int64)]}
                known = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False) & (rows["n"] > 0))
                keep = np.zeros(hi - lo, bool)
                if len(known):
                    first = known[_same_sets(rows[known])]
                    keep[known[first == known]] = True
                    twin = first != known
                    out["kind"].append(np.full(twin.sum(), 1, np.int32)), out["a"].append(rows["doc"][known[twin]]), out["n"].append(rows["doc"][first[twin]])
                n = rows["n"].astype(np.int64)[row]
                at = np.arange(len(row)) - np.repeat(np.cumsum(rows["n"], dtype=np.int64) - rows["n"], rows["n"])
                take = np.flatnonzero((at < n - -(-percent * n // 100) + 1) & keep[row])
                posts = np.empty(len(take), _POSTS)
                posts["token"], posts["row"], posts["at"] = token[take], row[take], at[take]
                bucket = (mix(posts["token"]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                posts, bucket = posts[order], bucket[order]
                edges = np.flatnonzero(np.append(True, np.diff(bucket) != 0))[: len(bucket)]
                blobs, where = [], []
                for i, j in zip(edges, np.append(edges[1:], len(bucket))):
                    part = posts[i:j].copy()
                    used, part["row"] = np.unique(part["row"], return_inverse=True)
                    blobs.append(_blob(rows[used], part)), where.append(int(bucket[i]))
                kind, a, n = (np.concatenate(out[c]) for c in ("kind", "a", "n"))
                doc = pa.array(a, mask=np.append(~ids.is_valid().to_numpy(zero_copy_only=False), np.zeros(len(a) - (hi - lo), bool)))
                none = pa.nulls(len(blobs), pa.int64())
                made = pa.array(_sketches(token, np.append(0, np.cumsum(rows["n"], dtype=np.int64))), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(kind), pa.array(np.full(len(blobs), 2, np.int32))]),
                        pa.concat_arrays([doc, none]),
                        pa.concat_arrays([pa.array(n), none]),
                        pa.concat_arrays([pa.nulls(len(a), pa.int32()), pa.array(where, pa.int32())]),
                        pa.concat_arrays([made, pa.nulls(len(a) - (hi - lo), pa.binary()), pa.array(blobs, pa.binary())]),
                    ],
                    ["kind", "a", "n", "bucket", "entries"],
                )

    return run


def _may_link(n1: np.ndarray, at1: np.ndarray, n2: np.ndarray, at2: np.ndarray, percent: int) -> np.ndarray:
    need = -(-percent * (n1 + n2) // (100 + percent))
    return (percent * np.maximum(n1, n2) <= 100 * np.minimum(n1, n2)) & (np.minimum(at1, at2) + np.minimum(n1 - at1, n2 - at2) >= need)


def _lists(percent: int, long_list: int | None):
    """Rows of kind 1: two documents with equal sets; 3: pairs that may link; 4: entries of lists that pairs leave open."""

    def run(table: pa.Table) -> pa.Table:
        rows, posts, base = [], [], 0
        for blob in table.column("entries").to_pylist():
            r, p = _unblob(blob)
            p["row"] += np.uint32(base)
            base += len(r)
            rows.append(r), posts.append(p)
        rows, posts = np.concatenate(rows), np.concatenate(posts)
        split = table.column("parts")[0].as_py() > 1  # the rest of its lists is in other tasks
        first = _same_sets(rows)
        twin = np.flatnonzero(rows["doc"] != rows["doc"][first])
        links = np.unique(np.stack([rows["doc"][twin], rows["doc"][first[twin]]], 1), axis=0) if len(twin) else np.empty((0, 2), np.int64)
        row = first[posts["row"]]
        token, doc, n, at = posts["token"], rows["doc"][row], rows["n"][row].astype(np.int64), posts["at"].astype(np.int64)
        order = np.lexsort((doc, n, token))
        token, doc, n, at = token[order], doc[order], n[order], at[order]
        keep = np.append(True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]) | (n[1:] != n[:-1]))[: len(token)]
        token, doc, n, at = token[keep], doc[keep], n[keep], at[keep]
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))[: len(token)]
        size = np.diff(np.append(begin, len(token)))
        most = long_list or len(token)
        left, right = [], []
        members, d = np.flatnonzero(np.repeat((size > 1) & (size <= most), size)), 0
        while len(members) and not split:
            d += 1
            i = members[members + d < len(token)]
            i = i[(token[i] == token[i + d]) & (percent * n[i + d] <= 100 * n[i])]  # beyond its block a set has no partner
            left.append(i), right.append(i + d)
            members = i
        long = np.flatnonzero(np.repeat(size > most, size))
        if len(long):
            block = np.floor(np.log(n[long]) / np.log(100 / min(percent, 99))).astype(np.int64)
            order = np.lexsort((mix(doc[long].view(np.uint64)), block, token[long]))
            long, block = long[order], block[order]
            new = np.append(True, (token[long[1:]] != token[long[:-1]]) | (block[1:] != block[:-1]))
            leader = long[np.maximum.accumulate(np.where(new, np.arange(len(long)), 0))]
            left.append(leader[~new]), right.append(long[~new])
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        ok = _may_link(n[i], at[i], n[j], at[j], percent) & (doc[i] != doc[j])
        i, j = i[ok], j[ok]
        pairs = np.unique(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])], 1), axis=0) if len(i) else np.empty((0, 2), np.int64)
        rest = np.arange(len(token)) if split else np.sort(long)
        none = [pa.nulls(len(links) + len(pairs), pa.int64())]
        return pa.table(
            {
                "kind": np.repeat(np.array([1, 3, 4], np.int32), [len(links), len(pairs), len(rest)]),
                "a": np.concatenate([links[:, 0], pairs[:, 0], doc[rest]]),
                "b": pa.concat_arrays([pa.array(np.concatenate([links[:, 1], pairs[:, 1]])), pa.nulls(len(rest), pa.int64())]),
                "token": pa.concat_arrays([*none, pa.array(token[rest].view(np.int64))]),
                "n": pa.concat_arrays([*none, pa.array(n[rest])]),
                "at": pa.concat_arrays([*none, pa.array(at[rest])]),
            }
        )

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_slices(batch.column(2), _PIECE // 3):  # the other text is about as long
                part = batch.slice(lo, hi - lo)
                # a text that many pairs share is laid out once
                place: dict[bytes, int] = {}
                sides = [[place.setdefault(t, len(place)) for t in as_bytes(part.column(c))] for c in (2, 3)]
                row, key = shingles(list(place), k)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[: len(row)]
                row, key = row[new], key[new]
                cut = np.searchsorted(row, np.arange(len(place) + 1))
                ok = []
                for x, y in zip(*sides):
                    p, q = key[cut[x] : cut[x + 1]], key[cut[y] : cut[y + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
                yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _near_sketches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n1, n2, s1, s2 in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5))):
                x, y = np.frombuffer(s1, np.uint8), np.frombuffer(s2, np.uint8)
                size = min(len(x), len(y))
                ok.append(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) * (100 + percent) <= (n1 + n2) * (100 - percent))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) without those whose sketches (id, n, sketch) show that they can't link, so that few pairs need their texts."""
    one, two = (sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return materialize(both.mapInArrow(lean(_near_sketches(percent)), "a bigint, b bigint").distinct(), "possible")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose texts link. A document with many partners is split by AQE's skew join."""
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    used = pairs.select(F.explode(F.array("a", "b")).alias("used")).distinct()
    if used.limit(NARROW_ROWS + 1).count() <= NARROW_ROWS:  # few documents: only their texts are shuffled
        texts = texts.join(F.broadcast(used), texts["doc_id"] == used["used"], "left_semi")
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(lean(_confirm(k, percent)), "a bigint, b bigint")


def _open_pairs(doc: np.ndarray, group: np.ndarray, n: np.ndarray, at: np.ndarray, side: np.ndarray, sketch: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, places of sketches that differ) of a list's members in different groups that sketches don't rule out.

    side: members of one side only meet those of the other, unless all are of one side."""
    length = np.array([len(x) for x in sketch])
    order = np.lexsort((n, length))
    doc, group, n, at, side, length = (x[order] for x in (doc, group, n, at, side, length))
    two = side.min() != side.max()
    found: list[tuple[np.ndarray, ...]] = []
    for size in np.unique(length):
        lo, hi = np.searchsorted(length, size, "left"), np.searchsorted(length, size, "right")
        stop = lo + int(np.searchsorted(n[lo:], 100 * n[hi - 1] // percent, "right"))
        words = np.stack([_folded(np.frombuffer(sketch[order[x]], np.uint8), size) for x in range(lo, stop)]).view(np.uint64)
        for i in range(lo, hi):
            last = i + 1 + int(np.searchsorted(n[i + 1 :], 100 * n[i] // percent, "right"))
            j = np.arange(i + 1, last)
            j = j[(group[j] != group[i]) & (doc[j] != doc[i]) & ((side[j] != side[i]) if two else True)]
            j = j[_may_link(n[i], at[i], n[j], at[j], percent)]
            if len(j):
                differ = np.bitwise_count(words[j - lo] ^ words[i - lo]).sum(axis=1, dtype=np.int64)
                ok = differ * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
                found.append((np.full(ok.sum(), order[i]), order[j[ok]], differ[ok]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def _forest(i: np.ndarray, j: np.ndarray, weight: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places of the pairs of a spanning forest of groups, light ones first: each round every tree takes its lightest pair."""
    _, tree = np.unique(group, return_inverse=True)
    rank, taken = np.empty(len(i), np.int64), []
    rank[np.lexsort((j, i, weight))] = np.arange(len(i))
    back = np.argsort(rank)
    while len(left := np.flatnonzero(tree[i] != tree[j])):
        best = np.full(tree.max() + 1, len(i))
        np.minimum.at(best, tree[i[left]], rank[left])
        np.minimum.at(best, tree[j[left]], rank[left])
        chosen = back[np.unique(best[best < len(i)])]
        taken.append(chosen)
        nodes, root = merged(tree[i[chosen]], tree[j[chosen]])
        tree = np.where(np.isin(tree, nodes), root[np.minimum(np.searchsorted(nodes, tree), len(nodes) - 1)], tree)
    return np.concatenate(taken) if taken else np.empty(0, np.int64)


def _cells(percent: int, forest: bool):
    def run(table: pa.Table) -> pa.Table:
        token, lo, hi, part, doc, group, n, at = (table.column(c).to_numpy() for c in ("token", "lo", "hi", "part", "a", "c", "n", "at"))
        sketch = table.column("sketch").to_pylist()
        order = np.lexsort((hi, lo, token))
        new = np.append(True, (np.diff(token[order]) != 0) | (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0))
        edges = np.append(np.flatnonzero(new), len(order))
        out = [np.empty((0, 2), np.int64)]
        for b, e in zip(edges[:-1], edges[1:]):
            cell = order[b:e]
            i, j, differ = _open_pairs(doc[cell], group[cell], n[cell], at[cell], part[cell], [sketch[x] for x in cell], percent)
            if forest:
                used = _forest(i, j, differ, group[cell])
                i, j = i[used], j[used]
            i, j = doc[cell[i]], doc[cell[j]]
            out.append(np.stack([np.minimum(i, j), np.maximum(i, j)], 1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def open_pairs(entries: DataFrame, groups: DataFrame, sketches: DataFrame, percent: int, forest: bool, cell: int = CELL) -> DataFrame:
    """Pairs (a, b) across components that entries (a, token, n, at) of long lists leave open. A list is cut into parts of
    about `cell` members, and each two of its parts meet in a cell."""
    placed = materialize(entries.join(groups, entries["a"] == groups["node"], "left").select("a", "token", "n", "at", F.coalesce("component", "a").alias("c")), "placed")
    mixed = placed.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("m")).where("c1 != c2").select("token", F.ceil(F.col("m") / cell).alias("parts"))
    mixed = materialize(mixed, "mixed")
    rows = placed.join(small_or_plain(mixed, NARROW_ROWS), "token").withColumn("part", F.pmod(F.xxhash64("a"), "parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("a", "token", "n", "at", "c", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    rows_kept = rows = materialize(rows, "cells")
    deals = max(1, rows.count() // (4 * cell))
    known = sketches.select(F.col("id").alias("a"), F.col("n").alias("own"), "sketch")
    rows = rows.join(known, "a").where("n = own").drop("own")  # of rows that share a doc_id, those the entry can be of
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("token", "lo", "hi"), F.lit(deals)))
    out = materialize(dealt.groupBy("deal").applyInArrow(_cells(percent, forest), "a bigint, b bigint").distinct(), "open")
    done_with(placed, mixed, rows_kept)
    return out


def _indexed(docs: DataFrame, k: int, percent: int, long_list: int | None, bucket_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of _index, rows of _lists, sketches as (id, n, sketch))."""
    small_batches(docs.sparkSession)
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs, k))
    index = materialize(docs.mapInArrow(lean(_index(k, percent, buckets_for(docs), levels)), "kind int, a bigint, n bigint, bucket int, entries binary"), "index")
    levels.destroy()  # executors need not hold it any longer
    entries = index.where("kind = 2").select("bucket", "entries")
    parts = entries.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("entries")) / bucket_bytes).alias("parts")).where("parts > 1")
    parts = small_or_plain(materialize(parts, "parts"), NARROW_ROWS)
    dealt = entries.join(parts, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("entries"), "parts")).otherwise(0))
    found = materialize(dealt.groupBy("bucket", "part").applyInArrow(_lists(percent, long_list), _FOUND), "lists")
    return index, found, index.where("kind = 0 and a is not null and n > 0").select(F.col("a").alias("id"), "n", F.col("entries").alias("sketch"))


def _equal(index: DataFrame, found: DataFrame) -> DataFrame:
    return index.where("kind = 1").select("a", F.col("n").alias("b")).union(found.where("kind = 1").select("a", "b"))


def linked_pairs(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """((a, b) with a < b: all pairs of linked classes; (doc_id, class_id): the class of each document).

    A class is of documents with equal sets and named by its least doc_id; documents of a class link each other. Documents
    without words or doc_id have no class."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    index, found, sketches = _indexed(docs, k, percent, None, bucket_bytes)
    pairs = possible(found.where("kind = 3").select("a", "b").distinct(), sketches, percent)
    none = docs.sparkSession.createDataFrame([], "node bigint, component bigint")
    pairs = pairs.union(open_pairs(found.where("kind = 4"), none, sketches, percent, False, cell)).distinct()
    links = materialize(confirmed(pairs, docs, k, percent), "links")
    equal = materialize(components(_equal(index, found)), "classes")
    known = index.where("kind = 0 and a is not null and n > 0").select(F.col("a").alias("doc_id")).distinct()
    classes = known.join(equal, known["doc_id"] == equal["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
    one, two = (classes.select(F.col("doc_id").alias(x), F.col("class_id").alias(f"of_{x}")) for x in "ab")
    links = links.join(one, "a").join(two, "b").where("of_a != of_b")
    return links.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct(), classes


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, long_list: int = LONG_LIST, bucket_bytes: int = BUCKET_BYTES, cell: int = CELL) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs (doc_id bigint, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    index, found, sketches = _indexed(docs, k, percent, long_list, bucket_bytes)
    tried = possible(found.where("kind = 3").select("a", "b").distinct(), sketches, percent)
    links = materialize(confirmed(tried, docs, k, percent).union(_equal(index, found)), "links")
    groups = materialize(components(links), "groups")
    done_with(links)
    entries = found.where("kind = 4").select("a", "token", "n", "at")
    if not entries.isEmpty():
        for forest in (True, False):
            asked = open_pairs(entries, groups, sketches, percent, forest, cell)
            new = materialize(asked.join(tried, ["a", "b"], "left_anti"), "asked")
            more = materialize(confirmed(new, docs, k, percent), "more")
            if n := more.count():
                groups = materialize(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "groups")
            if n == asked.count():  # each answer was yes, so what the forest connects is one component
                break
            tried = tried.union(new)
    out = materialize(index.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles")), "sizes")
    done_with(found, index)
    return out.join(groups, out["doc_id"] == groups["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without those that are in a component with a smaller doc_id; rows with null doc_id stay."""
    gone = near_duplicates(docs, k, percent).where("component_id != doc_id").select(F.col("doc_id").alias("_pl_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_pl_gone"], "left_anti")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)]) END AS items FROM d
), e AS (
  SELECT r, doc_id, len(items) AS n, unnest(items) AS item FROM s WHERE doc_id IS NOT NULL
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.item = b.item AND a.r <> b.r GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT DISTINCT doc_id, doc_id FROM s WHERE doc_id IS NOT NULL UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(items) AS BIGINT) AS n_shingles, component_id FROM s LEFT JOIN least ON a = doc_id
"""
