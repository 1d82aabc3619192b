"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

A text is tokenised once. Its ids are cut into pieces of the sequence length and a remainder; a full piece is a sequence of
its own. Remainders of a randomly drawn group of documents go, longest first, into the first open sequence that has room;
a tree whose nodes hold the most room below them finds it in logarithmic time. Groups are independent, of about
GROUP_DOCS documents each whatever the size of the input, drawn by the row's place in the input files, so that equal rows
spread like others; a task that runs again draws the same.

The vocabulary cuts a text into parts (runs of letters, digits, signs) and merges within each part only, so the ids of a text
are those of its parts in turn, and each distinct part is merged once in a worker, which keeps what it met first from task
to task, within bounds. Tests compare this with whole texts.

Defined cases: a null text is empty and has the end id alone; rows that repeat are packed as often as they occur; a very
long text is cut into as many pieces as it needs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches
from .words import Words, mix, row_slices

CAPACITY = 4096
END_ID = 2
GROUP_DOCS = 2048
SEED = 17
#: Ids and words that a worker keeps while it works, and of them from task to task.
_KEPT_IDS, _HELD_WORDS = 2_000_000, 60_000
_PIECE = 1_900_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as itself, the rest in turn from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip(shown, shown)) | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}


class _Tokens(dict):
    """Ids of texts. A text of Latin letters is cut as the vocabulary's own file says, and each distinct part is merged once
    and kept, as is each distinct word; other texts go through the tokenizer whole. Keys: parts; values: places in sizes and starts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = [t["content"] for t in said["added_tokens"]]
        latin = [chr(c) for c in range(0x250)]
        of = lambda kinds: "".join(c for c in latin if unicodedata.category(c)[0] in kinds)
        space = "".join(c for c in latin if c in "\t\n\x0b\x0c\r \x85\xa0")
        pattern = said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name, letters in (("[\\p{L}]", f"[{of('L')}]"), ("[\\p{N}]", f"[{of('N')}]"), ("\\s", space), ("\\p{L}", of("L")), ("\\p{N}", of("N"))):
            pattern = pattern.replace(name, letters)
        self.parts = re.compile(pattern).findall
        self.plain = re.compile("[\x00-\u012f\u0131-\u024f]*").fullmatch
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.words: dict[bytes, int] = {}
        self.pool, self.sizes, self.starts = array("I"), array("q"), array("q")
        self._keep([END_ID])

    def trim(self, places: int = _HELD_WORDS) -> bool:
        """Keeps about that many of the parts and words that came first, which common ones do; whether anything went."""
        if len(self.sizes) <= places:
            return False
        if self.starts[places] > _KEPT_IDS // 2:  # very long parts
            self.forget()
            return True
        kept = [(x, {k: v for k, v in x.items() if v < places}) for x in (self, self.words)]
        for x, left in kept:
            x.clear()
            x.update(left)
        del self.pool[self.starts[places] :], self.sizes[places:], self.starts[places:]
        return True

    def _keep(self, ids: list[int]) -> int:
        self.starts.append(len(self.pool))
        self.sizes.append(len(ids))
        self.pool.extend(ids)
        return len(self.sizes) - 1

    def __missing__(self, part: str) -> int:
        spelled = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(self.letters)
        self[part] = at = self._keep([t.id for t in self.tokenizer.model.tokenize(spelled)])
        return at

    def word(self, word: bytes) -> int:
        """The place of a word's ids."""
        places = [self[p] for p in self.parts(unicodedata.normalize("NFC", word.decode()).lower())]
        at = places[0] if len(places) == 1 else self._keep([x for p in places for x in self.pool[self.starts[p] : self.starts[p] + self.sizes[p]]])
        self.words[word] = at
        return at

    def ids(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all docs with the end id after each, where each begins and the last ends)."""
        if len(self.pool) > _KEPT_IDS:
            self.trim()
        plain = [bool(self.plain(d)) and not any(s in d for s in self.special) for d in docs]
        words = Words([d.encode() if ok else b"" for d, ok in zip(docs, plain)])
        distinct, index = words.distinct()
        get = self.words.get
        place = np.fromiter((self.word(w) if (at := get(w)) is None else at for w in distinct.to_pylist()), np.int64, len(distinct))
        close = np.array([0 if ok else self._keep([*self.tokenizer.encode(d, add_special_tokens=False).ids, END_ID]) for d, ok in zip(docs, plain)], np.int64)
        seq = np.insert(place[index], words.offsets[1:], close)
        pool, size, start = np.array(self.pool, "<u4"), np.array(self.sizes), np.array(self.starts)
        sizes = size[seq]
        ends = np.cumsum(sizes)
        at = np.repeat(start[seq] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return pool[at], np.append(0, ends[words.offsets[1:] + np.arange(len(docs))])


_made: dict[str, _Tokens] = {}


def _tokens(path: str) -> _Tokens:
    """One of each in a Python worker, which Spark uses for many tasks."""
    if path not in _made:
        _made[path] = _Tokens(path)
    return _made[path]


def _pieces(path: str, capacity: int, groups: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, row_id = _tokens(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, hi in row_slices(batch.column(1), _PIECE):
                ids, bounds = tokens.ids([x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()])
                total = np.diff(bounds)
                n = -(-total // capacity)
                row = np.repeat(np.arange(hi - lo), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(total[row] - start, capacity)
                view, first = memoryview(ids).cast("B"), bounds[row] + start
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                doc = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                drawn = mix(mix(np.arange(row_id, row_id + hi - lo, dtype=np.uint64)) + np.uint64(seed)) % np.uint64(groups)
                row_id += hi - lo
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(x, pa.int64()) for x in (start, length, crc, total[row])), pa.array(drawn[row].astype(np.int32))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_pl_group"])
        tokens.trim()
        give_back()

    return run


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. The tree's leaves are bins in order of opening, each node has the most room below it."""
    size = 1 << max(1, (max(len(lengths), 1) - 1).bit_length())
    room = [capacity] * (2 * size)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < size:  # the leftmost leaf with enough room
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - room[node]
        room[node] -= need
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = [table.column(c).to_numpy() for c in ("ids_crc32", "length", "start")]
        doc = table.column("doc_id").fill_null(-1).to_numpy()
        table = table.take(pa.array(np.lexsort([*keys, doc])))  # reruns agree whatever order the rows came in
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        group = int(table.column("_pl_group")[0].as_py())
        table = table.drop_columns(["_pl_group"])
        return table.append_column("sequence_id", pa.array((np.int64(group) << np.int64(32)) + bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = SEED) -> DataFrame:
    """Pieces of docs (doc_id, text) with the sequence and the offset each one is packed to."""
    small_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    dealt = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(path or vocabulary_path(), capacity, groups, seed), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, _pl_group int")
    return dealt.groupBy("_pl_group").applyInArrow(_pack(capacity), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
