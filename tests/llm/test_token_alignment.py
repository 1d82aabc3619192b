"""Cross-tokenizer alignment against whole texts, encoded one by one."""

import collections
import hashlib
import random

import pytest

from pagelens.llm import token_alignment as ta

SCHEMA = "doc_id bigint, text string, key bigint, _x string"


def texts():
    rnd = random.Random(3)
    letters = "abc déß ,.'’0123 \n\t ▁<|>日本語é́\x00 　😀-"
    mixed = ["".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(60)]
    words = ["the", "of", "naïve", "l'été", "don't", "x" * 90, "<s>", "<|endoftext|>", "<0x41>", "über,", "3,141.59"]
    return mixed + [" ".join(rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(40)] + ["", " ", "  a", "a  b", "a ", "\n", "a▁b", "the the the", "the the the", "long word " * 4000, None]


ROWS = [(i, t, i, "x") for i, t in enumerate(texts())] + [(3, "the of", 1, "y"), (None, "the of", 1, "z")]


def brute(rows):
    v = ta.Vocabularies(ta.vocabulary_paths())
    docs, held = [], collections.Counter()
    for _, text, *_ in rows:
        if not text:
            docs.append(None)
            continue
        (a,), (b,) = v.encode([text])
        want = b" " + text.encode()
        if b"".join(v.a_bytes[x] for x in a) != want or b"".join(v.b_bytes[x] for x in b) != want:
            docs.append(None)
            continue
        spans = []
        for ids, of in ((a, v.a_bytes), (b, v.b_bytes)):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(of[x]), x))
                at += len(of[x])
            spans.append(out)
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e] if len(a) < 500 else []
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        if len(a) >= 500:  # the long one: the same overlaps, met in order
            i = j = 0
            while i < len(a):
                links.append((a[i], b[j]))
                x, y = spans[0][i][1], spans[1][j][1]
                i, j = i + (x <= y), j + (y <= x)
        groups, last = [], 0
        for e in both:
            groups.append("|".join(",".join(str(x) for s, f, x in spans[k] if last <= s and f <= e) for k in (0, 1)) if len(a) < 500 else None)
            last = e
        docs.append((len(a), len(b), len(both), links, groups))
        held.update(set(links))
    best = collections.Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, *_), d in zip(rows, docs):
        if d is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = d
        digest = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, n_a, n_b, n_groups, len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), digest))
    return out


@pytest.mark.parametrize("shard_pairs", [50, 1 << 21])
def test_alignment(spark, shard_pairs):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = [tuple(r) for r in ta.alignments(docs, shard_pairs=shard_pairs).collect()]
    want = brute(ROWS)
    long = next(i for i, (_, t, *_) in enumerate(ROWS) if t and len(t) > 30_000)
    assert sorted((g[:7] for g in got), key=str) == sorted((w[:7] for w in want), key=str)
    known = {w[0]: w[7] for w in want if w[0] is not None}
    assert all(g[7] == known[g[0]] for g in got if g[0] not in (None, 3, long))


def test_groups_and_empty(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in ta.alignments(docs, whole=True).collect()}
    assert rows[1].groups_sha256 == hashlib.sha256(rows[1].groups.encode()).hexdigest() and rows[1].groups.count(";") == rows[1].n_groups - 1
    assert rows[2].groups == "" == rows[2].groups_sha256
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert ta.alignments(none).count() == 0


def test_worker_forgets():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": ["the cat sat", "x  y", None, "a▁b the"]})
    cuts = ta.Cuts(ta.vocabulary_paths())
    first = ta._sliced(cuts, rows, True)
    again = ta._sliced(cuts, rows, True)
    cuts.forget()
    assert first.equals(again) and first.equals(ta._sliced(cuts, rows, True))


def test_many_batches(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join("".join(rnd.choices("etaoin", k=rnd.randint(1, 6))) for _ in range(3))) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert sorted(map(tuple, ta.alignments(docs).collect())) == sorted(brute(rows))
