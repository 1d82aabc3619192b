"""Many phrases at once: an Aho-Corasick automaton of loaded rules, run over each text in one pass.

Rules of today's size are literals in the plan, a test each. Rule sets of 10**5 phrases would make a plan of that size and
a pass over the page for each; here the phrases and the findings they stand for are two arrays, broadcast after a check of
their size, and a worker builds the automaton once. The cost of a page is that of its characters and hits."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: With more rules than this the automaton takes the place of literals; the findings are the same.
LITERAL_RULES = 2000
#: Bytes of phrases and findings that may be broadcast.
MOST_BYTES = 128 << 20

_built: dict[str, tuple] = {}


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_" or unicodedata.category(c) in ("Mn", "Mc", "Me", "Pc")


def _whole(text: str, start: int, end: int) -> bool:
    """Whether both ends of a hit are word boundaries."""
    before = start > 0 and _is_word(text[start - 1])
    after = end < len(text) and _is_word(text[end])
    return before != _is_word(text[start]) and after != _is_word(text[end - 1])


def _automaton(key: str, sent):
    """(automaton of places lists, findings) of a broadcast, built once in a worker; only the last rules are kept."""
    if key not in _built:
        import ahocorasick

        phrases, findings = sent.value
        places: dict[str, list[int]] = {}
        for i, p in enumerate(phrases):
            places.setdefault(p, []).append(i)
        found = ahocorasick.Automaton()
        for p, at in places.items():
            if p:
                found.add_word(p, (len(p), at))
        found.make_automaton()
        _built.clear()
        _built[key] = (found if places.keys() - {""} else None), places.get("", []), findings
    return _built[key]


def hits(text: str, automaton, always: Sequence[int], whole_words: bool) -> list[int]:
    """The places of the phrases that a text holds, in order."""
    seen = set(always)
    if automaton is not None:
        for last, (n, at) in automaton.iter(text):
            if at[0] not in seen and (not whole_words or _whole(text, last + 1 - n, last + 1)):
                seen.update(at)
    return sorted(seen)


def found(text: str, phrases: Sequence[str], findings: pa.Array, kind: str, whole_words: bool = False) -> Column:
    """The findings, an array of the kind, whose phrase is in a text column; in the order of the rules.

    A null text holds nothing; an empty phrase is in every text, as a whole word in none."""
    size = sum(len(p.encode()) + 8 for p in phrases) + findings.nbytes
    if size > MOST_BYTES:
        raise ValueError(f"rules of {size} bytes are too many to broadcast; split them")
    key, sent = uuid.uuid4().hex, SparkSession.active().sparkContext.broadcast((list(phrases), findings))

    def run(texts: pa.Array) -> pa.Array:
        automaton, always, what = _automaton(key, sent)
        ends, at = [0], []
        for text in texts.to_pylist():
            if text is not None:
                at += hits(text, automaton, () if whole_words else always, whole_words)
            ends.append(len(at))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), what.take(pa.array(at, pa.int64())))

    return F.arrow_udf(run, f"array<{kind}>")(F.col(text))
