"""Language-model scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(bin | class, history) * P(word | bin). Both softmaxes have hashed n-gram and skip
features: the last word, the one before, the last two together, and a bias; in that of bins each goes with the class.
Classes: the TOP most frequent words, each its own; all others by the cluster they occur in most in training (a hash of
the documents' lang) and by frequency; and one for words never seen in training. A class's words are dealt to BINS bins by
hash. Within a bin a word has the share of its count. The whole sums to one over the known words and one unseen event, as
the base score does. In training a word's class is that of its count less its own occurrence, which teaches the model
how often to expect rare and unseen words. Nothing of a held-out document but its own score depends on it.

Training documents are those with crc32(doc_id as text) % 7 not 2. Counts of all their words are exact: pieces of input
deal distinct words and counts to buckets of word hashes and get the totals back. Weights are trained in ROUNDS rounds over
all training tokens: every task makes AdaGrad steps on its pieces from the weights it was sent, and the changes are
averaged block by block in the executors, in two levels. Weights have a fixed size. Words are told apart by 64-bit hashes.

Defined cases: null text is empty and has the end token alone; a null doc_id is in training; repeated rows count and score each;
null lang is a cluster like others; without training tokens all words are unseen and score as the base does; words of equal
counts are ordered by hash where only some can be in TOP; a very long text is a piece of its own; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, lean, materialize, small_batches
from .words import Words, as_bytes, mix, row_slices

TOP = 24
CLUSTERS = 8
BANDS = 3
CLASSES = TOP + CLUSTERS * BANDS + 2
UNSEEN, END = CLASSES - 1, np.uint64(0x2545F4914F6CDD1D)
BINS = 32
CELLS = 4096
ROUNDS = 2
RATE = 0.3
_BATCH = 8192
_PIECE, _SLICE = 6 << 20, 1_900_000
#: Groups of tokens that are added up one by one; logits so far below the greatest that single precision may lose them.
_FEW, _LEAST = 16, -60.0
_BLOCKS = 16
#: Tasks' changes are averaged in so many groups first.
_LANES = 64


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(a) for a in arrays], "<u8").tobytes() + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(data, "<u8", len(kinds)), kinds):
        out.append(np.frombuffer(data, kind, int(n), at))
        at += out[-1].nbytes
    return out


_PIECES = "chunk bigint, kind int, bucket int, body binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["chunk", "kind", "bucket", "body"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Training documents (0) and held-out ones (1) apart, put together to _PIECE bytes of text or more: held-out texts don't
    move where pieces of training documents end, and large pieces share their words' lists."""
    waiting, sizes = ([], []), [0, 0]
    for batch in batches:
        held = np.array([held_out(i) for i in batch.column(0).to_pylist()], bool)
        for kind in (0, 1):
            at = np.flatnonzero(held == kind)
            if len(at):
                waiting[kind].append(batch.take(pa.array(at)))
                sizes[kind] += waiting[kind][-1].column(1).nbytes
            if sizes[kind] >= _PIECE:
                yield pa.Table.from_batches(waiting[kind]).combine_chunks().to_batches()[0], kind
                waiting[kind].clear()
                sizes[kind] = 0
    for kind in (0, 1):
        if waiting[kind]:
            yield pa.Table.from_batches(waiting[kind]).combine_chunks().to_batches()[0], kind


def _encode(buckets: int):
    """Pieces of input: kind 0, the tokens as places in the piece's own list of words; kind 1, that list by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = [TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 32 | 1 << 31]
        for batch, kind in _apart(batches):
            for lo, hi in row_slices(batch.column(1), 2 * _PIECE):
                chunk = chunks[kind]
                text = batch.column(1).slice(lo, hi - lo)
                hashed, sizes = [], []
                for a, b in row_slices(text, _SLICE):  # hashing takes many bytes a byte of text
                    docs = Words([d.lower() for d in as_bytes(text.slice(a, b - a))])
                    hashed.append(np.insert(docs.hashes() if len(docs) else np.empty(0, np.uint64), docs.offsets[1:], END))
                    sizes.append(np.diff(docs.offsets) + 1)
                    del docs
                tokens, n = np.concatenate(hashed), np.concatenate(sizes)
                raw = batch.column(0).slice(lo, hi - lo)
                ids = raw.to_pylist()
                cluster = np.array([zlib.crc32((x or "").encode()) % CLUSTERS for x in batch.column(2).slice(lo, hi - lo).to_pylist()])
                held = np.array([held_out(i) for i in ids])
                words, place = np.unique(tokens, return_inverse=True)
                used = ~np.repeat(held, n)
                count = np.bincount(place[used], minlength=len(words)).astype(np.uint32)
                near = np.bincount((place * CLUSTERS + np.repeat(cluster, n))[used], minlength=len(words) * CLUSTERS).reshape(-1, CLUSTERS).argmax(axis=1).astype(np.uint8)
                known = np.array([i is not None for i in ids])
                body = _pack(np.array([i or 0 for i in ids], "<i8"), known, held, n.astype("<u4"), place.astype("<u4"))
                out = [(chunk, 0, -1, body)]
                bucket = ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # by range: words stay sorted
                edges = np.flatnonzero(np.append(True, np.diff(bucket) != 0))[: len(words)]
                out += [(chunk, 1, int(bucket[i]), _pack(words[i:j], count[i:j], near[i:j])) for i, j in zip(edges, np.append(edges[1:], len(words)))]
                chunks[kind] += 1
                yield _rows(out)

    return run


def _band(count: np.ndarray) -> np.ndarray:
    return (count >= 2).astype(np.int64) + (count >= 64)


def _bin(cell: np.ndarray) -> np.ndarray:
    return (cell >> np.uint32(27)).astype(np.int64)


def _cell(words: np.ndarray) -> np.ndarray:
    return (mix(words) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _totals(table: pa.Table) -> pa.Table:
    """Of a bucket: kind 1, each piece's totals for its words; kind 2, tokens and words by bin; kind 3, frequent words."""
    chunks = table.column("chunk").to_pylist()
    bucket = table.column("bucket")[0].as_py()
    parts = [_unpack(b, "<u8", "<u4", "u1") for b in table.column("body").to_pylist()]
    words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    count = np.bincount(place, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
    votes = np.bincount(place * CLUSTERS + np.concatenate([p[2] for p in parts]), np.concatenate([p[1] for p in parts]), len(words) * CLUSTERS)
    near = votes.reshape(-1, CLUSTERS).argmax(axis=1).astype(np.uint8)
    edges = np.cumsum([0] + [len(p[0]) for p in parts])
    out = [(c, 1, bucket, _pack(count[place[i:j]], near[place[i:j]])) for c, i, j in zip(chunks, edges[:-1], edges[1:])]
    seen = np.flatnonzero(count)
    at = (near[seen].astype(np.int64) * BANDS + _band(count[seen])) * BINS + _bin(_cell(words[seen]))
    n = CLUSTERS * BANDS * BINS
    out.append((0, 2, bucket, _pack(np.bincount(at, count[seen], n).astype(np.int64), np.bincount(at, minlength=n).astype(np.int64))))
    top = seen[np.argsort(-count[seen], kind="stable")[: TOP + 1]]
    out += [(int(words[i].view(np.int64)), 3, int(near[i]), int(count[i]).to_bytes(8, "big")) for i in top]
    return pa.Table.from_batches([_rows(out)])


class Vocabulary:
    """What is known of the counts as a whole; its size is fixed."""

    def __init__(self, top: list[tuple[int, int, int]], tokens: np.ndarray, words: np.ndarray):
        """top: (hash, cluster, count), tokens and words: of each bin of the rest, before top is taken out."""
        self.train_tokens, self.known_words = int(tokens.sum()), int(words.sum())
        rest = tokens.astype(np.int64).copy()
        for word, cluster, count in top:
            rest[(cluster * BANDS + int(_band(np.array(count)))) * BINS + int(_bin(_cell(np.array([word], np.uint64)))[0])] -= count
        self.rest = np.maximum(rest, 1).astype(np.float64)
        order = sorted(top)
        self.hashes = np.array([h for h, _, _ in order], np.uint64)
        #: Which bins of each class, and which classes, have words at all.
        self.bins = np.zeros((CLASSES, BINS), bool)
        self.bins[TOP + 1 : UNSEEN] = (rest > 0).reshape(-1, BINS)
        self.open = self.bins.any(axis=1)
        self.open[: len(order)] = self.open[UNSEEN] = True

    def classes(self, words: np.ndarray, count: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, class of the count less one, log10 share in the bin) of words with their totals."""
        at = np.minimum(np.searchsorted(self.hashes, words), max(len(self.hashes) - 1, 0))
        is_top = self.hashes[at] == words if len(self.hashes) else np.zeros(len(words), bool)

        def of(count: np.ndarray) -> np.ndarray:
            cls = TOP + 1 + near.astype(np.int64) * BANDS + _band(count)
            return np.where(is_top, at, np.where(count > 0, cls, UNSEEN))

        cls = of(count)
        share = np.zeros(len(words))
        inner = np.flatnonzero(~is_top & (count > 0))
        share[inner] = np.log10(count[inner] / self.rest[(cls[inner] - TOP - 1) * BINS + _bin(_cell(words[inner]))])
        return cls.astype(np.uint8), of(count - 1).astype(np.uint8), share


def _assemble(vocabulary: Broadcast):
    """A piece's documents with base scores, and its tokens as classes, features and shares: all that the model needs."""

    def run(table: pa.Table) -> pa.Table:
        v: Vocabulary = vocabulary.value
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "body"))))
        ids, known, held, n, place = _unpack(next(b for k, _, b in rows if k == 0), "<i8", "?", "?", "<u4", "<u4")
        words = np.concatenate([_unpack(b, "<u8", "<u4", "u1")[0] for k, _, b in sorted((r for r in rows if r[0] == 1), key=lambda r: r[1])])
        got = [_unpack(b, "<i8", "u1") for k, _, b in sorted((r for r in rows if r[0] == 5), key=lambda r: r[1])]
        count, near = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        ends = np.cumsum(n, dtype=np.int64)
        log = np.log10((count + 1) / (v.train_tokens + v.known_words + 1))
        sums = lambda x: np.diff(np.append(0, np.cumsum(x[place])[ends - 1]))
        base, seen = np.add.reduceat(log[place], ends - n), sums((count > 0).astype(np.int64))
        cls, less, share = v.classes(words, count, near)
        cell = _cell(words)
        docs = _pack(ids, known, held, n, seen, base)
        return pa.table({"chunk": table.column("chunk")[:1], "docs": pa.array([docs], pa.binary()), "tokens": pa.array([_pack(place, cell, cls, less, share.astype("<f4"))], pa.binary())})

    return run


def _features(cell: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows of the weights that each token uses: last word, the one before, both. begin: places where documents begin."""
    back = [np.concatenate([np.zeros(d, np.uint32), cell[:-d]]) if len(cell) > d else np.zeros(len(cell), np.uint32) for d in (1, 2)]
    end = np.append(begin[1:], len(cell))
    for d, b in zip((1, 2), back):
        for i in range(d):  # the second place only where a document has one
            b[begin[begin + i < end] + i] = 0x9E37 + i
    both = (back[0] * np.uint32(0x85EBCA6B)) ^ (back[1] * np.uint32(0xC2B2AE35))
    both ^= both >> np.uint32(15)
    return np.stack([back[0] % CELLS, CELLS + back[1] % CELLS, 2 * CELLS + both % CELLS], 1).astype(np.int32)


def _with_class(f: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Rows of the bins' weights: each feature together with the class, and the class alone."""
    out = np.empty((len(f), 4), np.int32)
    for i in range(3):
        x = (f[:, i].astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1) ^ (cls.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[:, i] = i * CELLS + ((x ^ (x >> np.uint32(13))) % np.uint32(CELLS)).astype(np.int32)
    out[:, 3] = 3 * CELLS + cls
    return out


def _is_inner(cls: np.ndarray) -> np.ndarray:
    return (cls > TOP) & (cls < UNSEEN)


def _logits(weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The last row counts for all where f has no column for it."""
    columns = np.ascontiguousarray(f.T)
    out, more = np.take(weights, columns[0], axis=0, mode="clip"), np.empty((len(f), weights.shape[1]), weights.dtype)
    for c in columns[1:]:
        out += np.take(weights, c, axis=0, out=more, mode="clip")
    if f.shape[1] == 3:
        out += weights[-1]
    return out


def _exponentials(z: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column right of each row of z, the rows' sums of exponentials), both less one constant. z becomes the exponentials."""
    rows = np.arange(len(z))
    z -= z.max()
    own = z[rows, right]
    if own.min() < _LEAST:  # far below other rows: a constant for each row
        z -= z.max(axis=1, keepdims=True)
        own = z[rows, right]
    np.exp(z, out=z)
    return own, z @ np.ones(z.shape[1], z.dtype)


def _log_softmax(z: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Natural logarithm of the share of column right of each row. Changes z."""
    own, sums = _exponentials(z, right)
    return own - np.log(sums)


class Weights:
    """Of classes, a row for each feature cell and one for the bias; of bins, a row for each cell and one for each class."""

    SHAPES = ((3 * CELLS + 1, CLASSES), (3 * CELLS + CLASSES, BINS))

    def __init__(self, flat: np.ndarray | None = None):
        n = [a * b for a, b in self.SHAPES]
        self.flat = np.zeros(sum(n), np.float32) if flat is None else flat
        self.classes, self.bins = (x.reshape(s) for x, s in zip(np.split(self.flat, [n[0]]), self.SHAPES))


def _sums(p: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the weights that f names, the sum of p over the tokens that name each). Columns of f name different rows.

    The first tokens of all groups are taken at once, then the second ones of those that have two, and so on; the few
    groups that have many more are added up each."""
    said = f.T.astype(np.int16).ravel()
    order = np.argsort(said, kind="stable")
    said = said[order]
    head = np.flatnonzero(np.append(True, said[1:] != said[:-1]))
    size = np.diff(head, append=len(order))
    largest = np.argsort(-size, kind="stable")
    head, size = head[largest], size[largest]
    token = order % len(f)
    more = np.searchsorted(-size, -np.arange(1, size[0] + 1))  # how many groups have more than so many tokens
    out = np.take(p, token[head], axis=0, mode="clip")
    turn = 1
    while turn < size[0] and (n := more[turn - 1]) > _FEW:
        out[:n] += np.take(p, token[head[:n] + turn], axis=0, mode="clip")
        turn += 1
    for i in range(more[turn - 1]):
        out[i] += np.take(p, token[head[i] + turn : head[i] + size[i]], axis=0, mode="clip").sum(axis=0)
    return said[head], out


def _adagrad(w: np.ndarray, sq: np.ndarray, used: np.ndarray, g: np.ndarray) -> None:
    """A step on the rows used, each named once, by the gradient g. Changes g."""
    root = sq[used]
    root += g * g
    sq[used] = root
    root += 1
    np.sqrt(root, out=root)
    g *= RATE
    g /= root
    w[used] -= g


def _step(w: np.ndarray, sq: np.ndarray, f: np.ndarray, target: np.ndarray) -> None:
    """One AdaGrad step on a batch."""
    p = _logits(w, f)
    p /= _exponentials(p, target)[1][:, None]
    p[np.arange(len(p)), target] -= 1
    _adagrad(w, sq, *_sums(p, f))
    if f.shape[1] == 3:
        _adagrad(w, sq, np.array([len(w) - 1]), p.sum(axis=0, keepdims=True))


_CHANGES = "block int, lane int, seen double, body binary"


def _gradient_steps(weights: Broadcast, turn: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, squares = weights.value
        w, sq, seen = Weights(start.copy()), Weights(squares.copy()), 0
        for batch in batches:
            for docs, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, _, held, n, _, _ = _unpack(docs, "<i8", "?", "?", "<u4", "<i8", "<f8")
                drawn = mix(ids.astype(np.uint64)) % np.uint64(rounds)  # a document's round, wherever it lies
                mine = ~held & (drawn == turn)  # every training document is in one round
                if not mine.any():
                    continue
                place, cell, _, less, _ = _unpack(tokens, "<u4", "<u4", "u1", "u1", "<f4")
                place, n = place[np.repeat(mine, n)], n[mine]
                cell = cell[place]
                f, target = _features(cell, np.cumsum(n, dtype=np.int64) - n), less[place].astype(np.int64)
                for i in range(0, len(cell), _BATCH):
                    at = slice(i, i + _BATCH)
                    _step(w.classes, sq.classes, f[at], target[at])
                    if len(inner := i + np.flatnonzero(_is_inner(target[at]))):
                        _step(w.bins, sq.bins, _with_class(f[inner], target[inner]), _bin(cell[inner]))
                seen += len(cell)
        if seen:
            parts = [_body(a, b) for a, b in zip(np.array_split(w.flat - start, _BLOCKS), np.array_split(np.sqrt(sq.flat), _BLOCKS))]
            lane = TaskContext.get().partitionId() % _LANES
            yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array([lane] * _BLOCKS, pa.int32()), pa.array([float(seen)] * _BLOCKS), pa.array(parts, pa.binary())], ["block", "lane", "seen", "body"])

    return run


def _body(change: np.ndarray, root: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.stack([change, root]).astype("<f2").tobytes())


def _average(table: pa.Table) -> pa.Table:
    """Changes and squares averaged by the tokens behind them."""
    seen, change, squares = 0.0, 0, 0
    for n, body in zip(table.column("seen").to_pylist(), table.column("body").to_pylist()):
        d, s = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), "<f2").astype(np.float64).reshape(2, -1)
        seen, change, squares = seen + n, change + n * d, squares + n * s * s
    return pa.table({"block": table.column("block")[:1], "lane": table.column("lane")[:1], "seen": pa.array([seen]), "body": pa.array([_body(change / seen, np.sqrt(squares / seen))], pa.binary())})


def train(pieces: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights, flat."""
    w, sq = Weights().flat, Weights().flat
    for turn in range(rounds):
        sent = pieces.sparkSession.sparkContext.broadcast((w, sq))
        made = pieces.select("docs", "tokens").mapInArrow(lean(_gradient_steps(sent, turn, rounds)), _CHANGES)
        made = made.groupBy("block", "lane").applyInArrow(_average, _CHANGES).groupBy("block").applyInArrow(_average, _CHANGES)
        parts = {r["block"]: np.frombuffer(zstandard.ZstdDecompressor().decompress(r["body"]), "<f2").astype(np.float32).reshape(2, -1) for r in made.collect()}
        if parts:
            both = np.concatenate([parts[b] for b in range(_BLOCKS)], axis=1)
            w, sq = w + both[0], both[1] * both[1]
    return w


def log_probability(weights: Weights, v: Vocabulary, f: np.ndarray, cls: np.ndarray, place: np.ndarray) -> np.ndarray:
    """log10 of P(class | history) * P(bin | class, history); place: the words' bins. Classes and bins without words are out."""
    z = _logits(weights.classes, f)
    z += np.where(v.open, 0, -np.inf).astype(z.dtype)
    log = _log_softmax(z, cls).astype(np.float64)
    if len(inner := np.flatnonzero(_is_inner(cls))):
        z = _logits(weights.bins, _with_class(f[inner], cls[inner]))
        z += np.take(np.where(v.bins, 0, -np.inf).astype(z.dtype), cls[inner], axis=0)
        log[inner] += _log_softmax(z, place[inner])
    return log / np.log(10)


def _score(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, v = model.value
        weights = Weights(flat)
        for batch in batches:
            for docs, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, known, held, n, seen, base = _unpack(docs, "<i8", "?", "?", "<u4", "<i8", "<f8")
                place, cell, cls, _, share = _unpack(tokens, "<u4", "<u4", "u1", "u1", "<f4")
                ends = np.cumsum(n, dtype=np.int64)
                cell = cell[place]
                f, target = _features(cell, ends - n), cls[place].astype(np.int64)
                log = share[place].astype(np.float64)
                for i in range(0, len(log), _BATCH) if v.train_tokens else ():
                    to = slice(i, i + _BATCH)
                    log[to] += log_probability(weights, v, f[to], target[to], _bin(cell[to]))
                score = np.add.reduceat(log, ends - n) if v.train_tokens else base
                cols = [pa.array(ids, mask=~known), pa.array(held), pa.array(n.astype(np.int64)), pa.array(seen), pa.array(np.full(len(n), v.train_tokens)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of docs (doc_id, text, lang), by a model trained on those that aren't held out."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    buckets = buckets_for(docs, 16 << 20, 32)
    pieces = materialize(docs.mapInArrow(lean(_encode(buckets)), _PIECES), "pieces")
    totals = materialize(pieces.where("kind = 1").groupBy("bucket").applyInArrow(_totals, _PIECES), "totals")
    top = [(r["chunk"] & (1 << 64) - 1, r["bucket"], int.from_bytes(r["body"], "big")) for r in totals.where("kind = 3").orderBy(F.desc("body"), "chunk").limit(TOP + 1).collect()]
    by_class = totals.where("kind = 2").select("body").mapInArrow(_class_rows, "class int, tokens bigint, words bigint").groupBy("class").agg(F.sum("tokens"), F.sum("words")).collect()
    tokens, words = np.zeros(CLUSTERS * BANDS * BINS, np.int64), np.zeros(CLUSTERS * BANDS * BINS, np.int64)
    for c, t, n in by_class:
        tokens[c], words[c] = t, n
    vocabulary = Vocabulary(top, tokens, words)
    replies = totals.where("kind = 1").select("chunk", F.lit(5).alias("kind"), "bucket", "body")
    whole = pieces.union(replies).groupBy("chunk").applyInArrow(_assemble(sc.broadcast(vocabulary)), "chunk bigint, docs binary, tokens binary")
    whole = materialize(whole, "tokens")
    model = sc.broadcast((train(whole, rounds), vocabulary))
    return whole.select("docs", "tokens").mapInArrow(lean(_score(model)), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column(0).to_pylist():
            tokens, words = _unpack(body, "<i8", "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tokens), dtype=np.int32)), pa.array(tokens), pa.array(words)], ["class", "tokens", "words"])


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
