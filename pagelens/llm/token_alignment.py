"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text, and how often they do.

Both vocabularies cut a text into tokens; each token is a range of bytes. Tokens whose ranges overlap are linked. A link is
packed into one int64, the first vocabulary's id in the high half. Texts are encoded once, and each document's distinct pairs
are written. Each task counts, with np.unique, in how many of its documents each pair occurs; these partial counts are dealt
by ranges of pairs, sorted, and runs of one pair are added up, which gives sorted shards of counts. Shards are files in the
shared folder; a last pass maps them into memory and looks the documents' pairs up by binary search. Pairs are at most the
product of the vocabularies, and a shard holds about SHARD_PAIRS of them whatever the size of the corpus.

A text is cut at single spaces between printable Latin characters: neither vocabulary has a token that covers such a place
from both sides, so that tokens, groups and links of a text are those of its cuts in turn, and each distinct cut is encoded
once in a worker, which keeps what it met within bounds. Tests compare this with whole texts.

Defined cases: texts that are null or empty, or whose tokens of either vocabulary don't spell them byte by byte, have no
tokens: zeros, and '' for the groups; rows that repeat, or share a doc_id, count as documents of their own; names of
special tokens in a text are plain text; ties for the highest count are all best; very long texts are taken whole; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import done_with, lean, materialize, own_dir, small_batches
from .words import row_slices

SHARD_PAIRS = 1 << 21
#: Bytes of text in a slice; distinct cuts and characters that a worker keeps; pairs in a task's partial counts.
_PIECE, _KEPT_CUTS, _KEPT_CHARS, _KEPT_PAIRS = 4 << 20, 500_000, 16 << 20, 1 << 22
_SHORT = 200
#: Fixed value: how the first vocabulary cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = "[!-~¡-ɏ]"
_CUT = re.compile(f"(?<={_LATIN}) (?={_LATIN})")
_PLAIN = re.compile(f"{_LATIN}+(?: {_LATIN}+)*+")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
_LINKED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Vocabularies:
    """Both tokenizers with the bytes of each of their tokens."""

    def __init__(self, paths: tuple[str, str]):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        self.a = Tokenizer.from_file(paths[0])
        self.a.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        spelled = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(letters[c] for c in spelled.get(i, "")) for i in range(max(spelled) + 1)]
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.a_bytes)}, special_tokens={})  # ids are in order of merges
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        #: An id and what follows it: of the first vocabulary "," or, at the end of a group, "|"; of the second "," or ";", or nothing at the end of a cut.
        self.said = [f"{i}{end}".encode() for i in range(len(self.a_bytes)) for end in ",|"] + [f"{i}{end}".encode() for i in range(len(self.b_bytes)) for end in (",", ";", "")]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each text: of the second vocabulary, which puts the space itself, of the text."""
        return [e.ids for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)

    def spells(self, a: list[int], b: list[int], raw: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))


def _counts(of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, minlength=n)


class Cuts(dict):
    """Tokens, groups and links of distinct cuts. Keys: cuts; values: places in the arrays."""

    def __init__(self, paths: tuple[str, str]):
        self.paths, self.vocabularies = paths, Vocabularies(paths)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.chars = 0
        self.sizes = array("q")  # of each cut in turn: tokens of either vocabulary, groups, links, the first link, whether it is spelled
        self.links = array("q")  # places of pairs
        self.groups: list[bytes] = []
        self.pairs: dict[int, int] = {}
        self.keys = array("q")

    def full(self) -> bool:
        return len(self) > _KEPT_CUTS or self.chars > _KEPT_CHARS or len(self.keys) > _KEPT_PAIRS

    def learn(self, texts: list[str]) -> None:
        v = self.vocabularies
        plain = [t for t in texts if len(t) <= _SHORT and _PLAIN.fullmatch(t)]
        if plain:
            raw = (" " + " ".join(plain)).encode()
            a, b = v.fast.encode_ordinary(raw.decode()), v.b.encode(plain, num_threads=1)
            b = [x for ids in b for x in ids]
            if v.spells(a, b, raw):
                self._align(plain, np.array(a), np.array(b))
            else:
                plain = []
        done = set(plain)
        rest = [t for t in texts if t not in done]
        good, all_a, all_b = [], [], []
        for text, a, b in zip(rest, *v.encode(rest)) if rest else ():
            if v.spells(a, b, b" " + text.encode()):
                good.append(text)
                all_a += a
                all_b += b
            else:
                self._keep([text], np.array([[len(a), len(b), 0, 0, len(self.links), 0]]), [b""])
        if good:
            self._align(good, np.array(all_a), np.array(all_b))

    def _keep(self, texts: list[str], sizes: np.ndarray, groups: list[bytes]) -> None:
        self.update(zip(texts, range(len(self.groups), len(self.groups) + len(texts))))
        self.groups += groups
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.chars += sum(map(len, texts))

    def _align(self, texts: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Keeps cuts that their tokens a and b spell, laid end to end: between two ends of tokens lies one link."""
        v, n = self.vocabularies, len(texts)
        end_a, end_b = np.cumsum(v.a_sizes[a]), np.cumsum(v.b_sizes[b])
        ends = np.cumsum([len(t.encode()) + 1 for t in texts])  # with the space before each
        every = np.union1d(end_a, end_b)
        keys, place = np.unique(a[np.searchsorted(end_a, every)] << 32 | b[np.searchsorted(end_b, every)], return_inverse=True)
        for key in keys.tolist():
            if key not in self.pairs:
                self.pairs[key] = len(self.keys)
                self.keys.append(key)
        first = len(self.links)
        self.links.frombytes(np.fromiter(map(self.pairs.__getitem__, keys.tolist()), np.int64, len(keys))[place].tobytes())
        both = end_a[end_b[np.searchsorted(end_b, end_a)] == end_a]
        of_a, of_b, cut = np.searchsorted(both, end_a), np.searchsorted(both, end_b), np.searchsorted(ends, both)
        n_a, n_b = _counts(of_a, len(both)), _counts(of_b, len(both))
        base = np.cumsum(n_a + n_b) - n_a - n_b
        said = np.empty(len(a) + len(b), np.int64)
        said[base[of_a] + np.arange(len(a)) - (np.cumsum(n_a) - n_a)[of_a]] = 2 * a + (both[of_a] == end_a)
        last = np.where(both[of_b] != end_b, 0, np.where(ends[cut[of_b]] == end_b, 2, 1))
        said[(base + n_a)[of_b] + np.arange(len(b)) - (np.cumsum(n_b) - n_b)[of_b]] = 2 * len(v.a_bytes) + 3 * b + last
        parts = list(map(v.said.__getitem__, said.tolist()))
        ids = [_counts(np.searchsorted(ends, e), n) for e in (end_a, end_b)]
        links = _counts(np.searchsorted(ends, every), n)
        stops = np.cumsum(ids[0] + ids[1]).tolist()
        sizes = np.column_stack([*ids, _counts(cut, n), links, first + np.cumsum(links) - links, np.ones(n, np.int64)])
        self._keep(texts, sizes, [b"".join(parts[i:j]) for i, j in zip([0, *stops], stops)])

    def places(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places of the cuts of all docs, where each doc begins and the last ends)."""
        cut = [d.split(" ") if _PLAIN.fullmatch(d) else _CUT.split(d) if d else [] for d in docs]
        new = list({c: None for cs in cut for c in cs if c not in self})
        for i in range(0, len(new), 20_000):
            self.learn(new[i : i + 20_000])
        begins = np.zeros(len(docs) + 1, np.int64)
        np.cumsum([len(c) for c in cut], out=begins[1:])
        return np.fromiter((self[c] for cs in cut for c in cs), np.int64, begins[-1]), begins


_held: list[Cuts] = []


def _cuts(paths: tuple[str, str]) -> Cuts:
    if not _held or _held[0].paths != paths:
        _held[:] = [Cuts(paths)]
    elif _held[0].full():
        _held[0].forget()
    return _held[0]


def _read(paths: tuple[str, str], whole: bool):
    """Of each document sizes, groups, and its distinct packed pairs in order with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in row_slices(batch.column(1), _PIECE):
                yield _sliced(_cuts(paths), batch.slice(i, j - i), whole)

    return lean(run)


def _sliced(cuts: Cuts, rows: pa.RecordBatch, whole: bool) -> pa.RecordBatch:
    n = rows.num_rows
    at, begins = cuts.places([t or "" for t in rows.column(1).to_pylist()])
    of = np.frombuffer(cuts.sizes, np.int64).reshape(-1, 6)[at]
    doc = np.repeat(np.arange(n), np.diff(begins))
    bad = _counts(doc[of[:, 5] == 0], n) > 0
    if bad.any():
        kept = ~bad[doc]
        at, of, doc = at[kept], of[kept], doc[kept]
    begins = np.searchsorted(doc, np.arange(n + 1))
    totals = [np.diff(np.concatenate([[0], np.cumsum(of[:, i])])[begins]) for i in range(4)]
    links, keys = of[:, 3], np.array(cuts.keys, np.int64)
    place = np.repeat(of[:, 4] - (np.cumsum(links) - links), links) + np.arange(links.sum())
    rank = np.argsort(keys, kind="stable")  # so that pairs of a document come in order
    order = np.empty(len(keys), np.int64)
    order[rank] = np.arange(len(keys))
    both = np.repeat(doc, links) * np.int64(len(keys)) + (order[np.frombuffer(cuts.links, np.int64)[place]] if len(place) else place)
    both, times = np.unique(both, return_counts=True)
    whose, pair = np.divmod(both, max(1, len(keys)))
    ends = np.searchsorted(whose, np.arange(n + 1))
    blobs = [pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (keys[rank[pair]], times.astype(np.int32))]
    get, b = cuts.groups.__getitem__, begins.tolist()
    said = [b";".join(map(get, at[i:j].tolist())) for i, j in zip(b, b[1:])]
    digests = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in said], pa.string())
    out = [rows.column(0), *(pa.array(t, pa.int64()) for t in totals), digests, *blobs] + [pa.array(said).cast(pa.string())] * whole
    return pa.RecordBatch.from_arrays(out, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"] + ["groups"] * whole)


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, where those of each row begin and the last end) of arrays in binary."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if column.buffers()[2] else np.empty(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), (ends - ends[0]) // np.dtype(kind).itemsize


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal keys, which are in order, as one with their counts added up."""
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class _Partial:
    """Counts of pairs, merged whenever what was added outgrows what is merged."""

    def __init__(self):
        self.keys, self.counts, self.added, self.n = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.added.append((keys, counts))
        self.n += len(keys)
        if self.n > max(1 << 19, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip((self.keys, self.counts), *self.added))
        order = np.argsort(keys, kind="stable")
        self.keys, self.counts = summed(keys[order], counts[order])
        self.added, self.n = [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for i in range(0, len(self.keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[i : i + (1 << 16)]), pa.array(self.counts[i : i + (1 << 16)])], ["key", "n"])
        self.__init__()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    partial = _Partial()
    for batch in batches:
        keys, n = np.unique(_flat(batch.column(0), np.int64)[0], return_counts=True)
        partial.add(keys, n.astype(np.int64))
        if len(partial.keys) > _KEPT_PAIRS:
            yield from partial.batches()
    yield from partial.batches()


def _local(uri: str) -> str | None:
    """The path of a folder that is mounted, as file: says; None for one that only a file system's library reaches."""
    return "/" + re.sub("^file:/+", "", uri).lstrip("/") if uri.startswith(("file:", "/")) else None


def _put(uri: str, table: pa.Table) -> None:
    """A file of one batch, which appears whole or not at all."""
    tried = f"{uri}.{uuid.uuid4().hex}"
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with pa.OSFile(_local(tried), "wb") as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        os.replace(_local(tried), path)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(tried)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as sink, pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    system.move(path, fs.FileSystem.from_uri(uri)[1])


def _get(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of a shard: mapped into memory where the folder is mounted, else read."""
    if path := _local(uri):
        source = pa.memory_map(path)
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        source = system.open_input_file(path)
    batch = pa.ipc.open_file(source).get_batch(0)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy()


def _sharded(folder: str):
    """Sorted partial counts of a range of pairs to a shard, and what it holds: (path, first, best of each first id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.empty(0, np.int64),) * 2]
        for batch in batches:
            keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(got[-1][0]) and len(keys) and got[-1][0][-1] == keys[0]:
                keys, n = np.concatenate([got[-1][0][-1:], keys]), np.concatenate([got[-1][1][-1:], n])
                got[-1] = tuple(x[:-1] for x in got[-1])
            got.append(summed(keys, n))
        keys, n = (np.concatenate(x) for x in zip(*got))
        if not len(keys):
            return
        path = f"{folder}/shard-{TaskContext.get().partitionId():06d}.arrow"
        _put(path, pa.table({"key": keys, "n": n}).combine_chunks())
        a = keys >> 32
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        m = len(first)
        yield pa.RecordBatch.from_arrays([pa.array([path] * m), pa.array(np.full(m, keys[0])), pa.array(a[first]), pa.array(np.maximum.reduceat(n, first))], ["path", "first", "a", "best"])

    return run


class Counts:
    """Counts of all pairs, in sorted shards: paths and the first pair of each. best: the highest count of each first id."""

    def __init__(self, paths: list[str], firsts: np.ndarray, best: np.ndarray):
        self.paths, self.firsts, self.best, self.opened = paths, firsts, best, {}

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys, which are in order and all in the shards."""
        out = np.empty(len(keys), np.int64)
        shard = np.searchsorted(self.firsts, keys, "right") - 1
        for s in np.unique(shard).tolist():
            path = self.paths[s]
            mapped = self.opened.get(path) or _get(path)
            if _local(path):  # others are read again, so that they don't add up
                self.opened[path] = mapped
            here = shard == s
            out[here] = mapped[1][np.searchsorted(mapped[0], keys[here])]
        return out


def linked(docs: DataFrame, paths: tuple[str, str] | None = None, whole: bool = False) -> DataFrame:
    """Documents (doc_id, text) read once: their sizes, groups and pairs, written to the shared folder; whole: groups as text."""
    small_batches(docs.sparkSession)
    used = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(used.mapInArrow(_read(paths or vocabulary_paths(), whole), _LINKED + ", groups string" * whole), "linked")


def pair_counts(rows: DataFrame, shard_pairs: int = SHARD_PAIRS) -> Counts:
    """In how many of linked's documents each pair of ids is linked. What comes to the driver is a row for each first id of a
    shard: at most the ids of the vocabulary and one more for each shard."""
    spark = rows.sparkSession
    partial = materialize(rows.select("pairs").mapInArrow(lean(_counted), "key bigint, n bigint"), "pairs")
    shards = max(1, -(-partial.count() // shard_pairs))
    folder = f"{own_dir(spark)}/shards-{uuid.uuid4().hex}"
    ranged = partial.repartitionByRange(shards, "key").sortWithinPartitions("key")
    held = ranged.mapInArrow(_sharded(folder), "path string, first bigint, a bigint, best bigint").collect()
    done_with(partial)
    found = sorted({(r.first, r.path) for r in held})
    best = np.zeros(1 + max((r.a for r in held), default=0), np.int64)
    for r in held:
        best[r.a] = max(best[r.a], r.best)
    return Counts([p for _, p in found], np.array([f for f, _ in found], np.int64), best)


def _looked_up(counts: Counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, begins = _flat(batch.column("pairs"), np.int64)
            times = _flat(batch.column("times"), np.int32)[0].astype(np.int64)
            asked, place = np.unique(keys, return_inverse=True)
            count = counts.of(asked)
            is_best = (count == counts.best[asked >> 32]) if len(asked) else count
            added = [np.diff(np.concatenate([[0], np.cumsum(times * x[place])])[begins]) for x in (is_best, count)]
            columns = {n: batch.column(n) for n in batch.schema.names} | {"n_best": pa.array(added[0], pa.int64()), "count_sum": pa.array(added[1], pa.int64())}
            names = [*COLUMNS, *(["groups"] if "groups" in columns else [])]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return lean(run)


def aligned(rows: DataFrame, counts: Counts) -> DataFrame:
    """COLUMNS of linked's documents by the counts of pairs in all of them."""
    small_batches(rows.sparkSession)
    kind = ", ".join(f"{c} {'string' if 'sha' in c else 'bigint'}" for c in COLUMNS)
    return rows.mapInArrow(_looked_up(counts), kind + ", groups string" * ("groups" in rows.columns))


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None, whole: bool = False, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """COLUMNS of docs (doc_id, text), and with whole the groups as text."""
    rows = linked(docs, paths, whole)
    return aligned(rows, pair_counts(rows, shard_pairs))


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
