"""Each corpus operator against brute force on small tables with nulls, empty texts, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import struct
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagelens.llm import chat_format, components, jaccard_join, language_id, lm_scoring, media, mixing, packing, substring_dedup, topk, url_filters

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kind int, _x string"


def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choices(words, k=rnd.randint(1, 60))) for _ in range(40)]
    passage = " ".join(rnd.choices(words, k=20))
    texts = base + [base[3], base[3], base[5] + " extra", base[7].replace(" ", "  \n"), base[9].upper()]
    texts += [f"a{i} b{i} {passage} c{i}" for i in range(6)] + [None, "", " \t\n", "one", "x " * 3000, " ".join(words[:150]), " ".join([*words[:149], "new"])]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 5}", len(t or ""), i, "x") for i, t in enumerate(texts)]
    return rows + [rows[2], (None, passage, "en", "s1", 1, 1, "y"), (1000, base[1], None, "s2", 1, 1, "y")]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def test_substring_dedup(docs, empty):
    k, seen = 13, {}
    for i, t, *_ in ROWS:
        w = split(t)
        for j in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[j : j + k])
                seen[key] = min(seen.get(key, i), i)
    want = []
    for i, t, *_ in ROWS:
        w, gone = split(t), set()
        for j in range(len(w) - k + 1):
            if i is not None and seen[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        want.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    got = [(r.doc_id, r._pl_words, r._pl_gone, r._pl_kept) for r in substring_dedup.dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substring_dedup.strip_repeats(docs).columns == docs.columns
    assert substring_dedup.dedup(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack(docs, capacity=256, group_docs=16).collect()
    ids = [(i, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in ROWS]
    want = collections.Counter((i, s, len(x[s : s + 256]), zlib.crc32(struct.pack(f"<{len(x[s : s + 256])}I", *x[s : s + 256])), len(x)) for i, x in ids for s in range(0, len(x), 256))
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(empty).count() == 0


def test_first_fit_is_first_fit():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        sizes = rnd.integers(1, 50, rnd.integers(0, 60))
        got, _ = packing.first_fit_decreasing(sizes, 64)
        room, want = [], np.zeros(len(sizes), int)
        for i in np.argsort(-sizes, kind="stable"):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(64)
            room[b] -= sizes[i]
            want[i] = b
        assert (got == want).all()


def test_tokens_of_odd_texts():
    tokens = packing._tokens(packing.vocabulary_path())
    rnd = random.Random(3)
    letters = "abS'tld  \n\t\x1c\x85\xa0éÀßİıſΣσ²½9_-<|>ÿŒ́😀ǅªK "
    for text in ["<|endoftext|> a<|startoftext|>b 'S it'll", "", *("".join(rnd.choices(letters, k=25)) for _ in range(2000))]:
        assert tokens.ids([text])[0].tolist() == [*tokens.tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def brute_jaccard(rows, k, percent):
    """(sets by row, linked pairs of doc_ids, find: the smallest doc_id reachable)."""
    sets, parent, pairs = [], {}, set()

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, t, *_ in rows:
        w = [x.lower() for x in split(t)]
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}))
    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
                pairs.add((min(a, b), max(a, b)))
    return sets, pairs, find


@pytest.mark.parametrize("k,percent,long_list,bucket_bytes,cell", [(3, 90, 16, 1 << 20, 1024), (2, 60, 1, 1 << 20, 4), (3, 80, 2, 200, 3)])
def test_jaccard(docs, empty, k, percent, long_list, bucket_bytes, cell):
    """Also with buckets that are split and lists of many cells."""
    sets, _, find = brute_jaccard(ROWS, k, percent)
    got = sorted(map(str, map(tuple, jaccard_join.near_duplicates(docs, k, percent, long_list, bucket_bytes, cell).collect())))
    assert got == sorted(str((i, len(s), None if i is None else find(i))) for i, s in sets)
    assert jaccard_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 200])
def test_jaccard_pairs(docs, bucket_bytes):
    """All links, from pairs of classes and their members. Only rows with a doc_id of their own."""
    rows = [r for i, r in enumerate(ROWS) if r[0] is not None and r[0] not in {x[0] for x in ROWS[:i]}]
    _, want, _ = brute_jaccard(rows, 2, 70)
    pairs, classes = jaccard_join.linked_pairs(docs.sparkSession.createDataFrame(rows, SCHEMA), 2, 70, bucket_bytes, 4)
    members = collections.defaultdict(list)
    for r in classes.collect():
        members[r.class_id].append(r.doc_id)
    got = {(min(x, y), max(x, y)) for m in members.values() for x in m for y in m}
    got |= {(min(x, y), max(x, y)) for a, b in pairs.collect() for x in members[a] for y in members[b]}
    assert got == want and len(got) > len(members)


def test_jaccard_group_of_copies(spark):
    """2000 different near copies of one text, many of them not linked with most others, and one that all lists hold."""
    rnd = random.Random(8)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(2000):
        w = list(base)
        for j in rnd.sample(range(120), rnd.randint(0, 6)):
            w[j] = f"n{rnd.random()}"
        rows.append((i, " ".join(w)))
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:])) for _, t in rows]
    first = np.array([[x in s for x in zip(base, base[1:], base[2:])] for s in sets], np.float32)  # all else is in one text alone
    both, size = first @ first.T, np.array([len(s) for s in sets])
    i, j = np.nonzero(100 * both >= 90 * (size[:, None] + size - both))
    nodes, root = components.merged(i, j)
    assert 100 < len(nodes) < 1900
    want = dict(zip(range(2000), range(2000))) | dict(zip(nodes.tolist(), root.tolist()))
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()}
    assert got == want


def test_merged():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        a, b = rnd.integers(0, 30, (2, rnd.integers(0, 40)))
        nodes, root = components.merged(a, b)
        at = dict(zip(nodes.tolist(), nodes.tolist()))
        for _ in range(40):
            for x, y in zip(a.tolist(), b.tolist()):
                at[x] = at[y] = min(at[x], at[y])
        assert dict(zip(nodes.tolist(), root.tolist())) == at


def test_forest():
    i, j, w = np.array([0, 0, 1, 3, 2]), np.array([1, 2, 2, 4, 2]), np.array([5, 1, 2, 9, 0])
    assert sorted(jaccard_join._forest(i, j, w, np.array([7, 8, 9, 4, 5])).tolist()) == [1, 2, 3]


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (7, 7), (1, 10), (10, 2), (2, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 1, 8: 8, 9: 8}


def test_language(spark, sf_dir, docs, empty):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = rows.join(language_id.identified(rows.drop("n_chars")).select("doc_id", "_pl_lang", "_pl_ok"), "doc_id").select((F.col("lang") == F.col("_pl_lang")).cast("int").alias("right"), F.col("_pl_ok").cast("int").alias("ok")).toPandas()
    assert got["right"].mean() > 0.97 and got["ok"].mean() > 0.97
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert kept.count() == docs.where("text rlike '[a-zA-Z]'").count()
    assert language_id.accepted(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.accepted(unlabelled).count() == kept.count()


def test_language_priors(spark):
    """Posteriors by brute force: text, markup and the other documents of the host, its suffix and all; on pages with markup too."""
    rnd = random.Random(12)
    letters = {"aa": "abcdefgh", "bb": "defghijk", "cc": "ghijklmn"}
    rows = []
    for i in range(90):
        lang = rnd.choice(list(letters))
        html = rnd.choice(["", f'<html lang="{lang}">', '<meta content-language="bb">'])
        text = html + "".join(rnd.choices(letters[lang] + "  ", k=rnd.choice((3, 8, 40))))
        rows.append((i, text if i % 13 else None, lang if i % 3 else None, rnd.choice(["x.org", "y.org", "z.de", "plain", None])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    langs, table = language_id.train(docs)
    log, _, n = language_id._evidence([(t or "").encode() for _, t, *_ in rows], langs, table)
    soft = [language_id._shares(x[None])[0] if k and t is not None else np.zeros(3) for x, k, (_, t, *_) in zip(log, n, rows)]
    ends = lambda s: s.rsplit(".", 1)[-1] if "." in s else ""
    want = {}
    for i, (doc, text, _, host) in enumerate(rows):
        if text is None or not n[i]:
            want[doc] = (None, 0.0)
            continue
        others = [(s, h) for j, (s, (_, _, _, h)) in enumerate(zip(soft, rows)) if j != i]
        total = sum(s for s, _ in others)
        prior = (total + 1) / (total.sum() + 3)
        if host is not None:
            for fits in (lambda h: ends(h) == ends(host), lambda h: h == host):
                c = sum([s for s, h in others if h is not None and fits(h)], np.zeros(3))
                prior = (c + language_id.PULL * prior) / (c.sum() + language_id.PULL)
        post = language_id._shares((log[i] + np.log(prior))[None])[0]
        want[doc] = (langs[post.argmax()], post.max())
    got = {r.doc_id: r for r in language_id.identified(docs).collect()}
    assert len(got) == 90 and {r._pl_said for r in got.values()} >= {"aa", "bb", None}
    for doc, (lang, sure) in want.items():
        assert got[doc]._pl_lang == lang and got[doc]._pl_sure == pytest.approx(sure, abs=2e-6)


def test_language_sample(spark):
    """The sample doesn't depend on how many rows have no label, and rare labels and rows without an id are in it by right."""
    schema = "doc_id bigint, text string, lang string"
    rows = [(i, f"text {i} of it", "en" if i % 2 else "de") for i in range(40)] + [(i, f"other {i}", None) for i in range(40, 6000)]
    few = spark.createDataFrame(rows, schema)
    assert language_id.train(few, 50)[0] == ["de", "en"] and language_id.sampled(few, 50).count() == 40
    rows = [(i, f"text {i}", "en") for i in range(5000)] + [(7, "rare text", "zz")] + [(None, f"no id {i}", "fr") for i in range(5000)] + [(8, "the same", "xx")] * 500
    n = {r["lang"]: r["count"] for r in language_id.sampled(spark.createDataFrame(rows, schema), 500).groupBy("lang").count().collect()}
    assert n["zz"] == 1 and n["xx"] in (1, 500) and 80 < n["en"] < 260 and 80 < n["fr"] < 260


def test_language_keeps_all_evidence(spark):
    """A tag's declaration counts however long the tag is, and every label is a language of its own."""
    place, long = {"de": 0}, b"x " * 500
    assert language_id._declared(b'<html class="' + long + b'" lang="DE">', place) == 0
    assert language_id._declared(b'<meta name="' + long + b'"><body xml:lang=de', place) == 0
    assert language_id._declared(b"<html> lang=de <p lang=de>", place) == language_id._declared(b"<meta " * 50000, place) == -1
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=80)), f"l{i:03}", f"h{i % 3}.org") for i in range(300)]
    got = language_id.identified(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert len(got) == 300 and all(r["lang"] == r["_pl_lang"] for r in got)


def test_url_filters(spark):
    html = '<a href="//bad.net/x">1</a><a href=https://a.org/>2</a>'
    urls = [(1, "http://A.com/x?q", html), (2, "https://www.example.com/en/1", ""), (3, "https://m.example.com/en/1", None), (4, "https://bad.net/es/1", ""), (5, "https://bad.net/fr/#", ""), (6, "https://bad.net/de/1", ""), (7, "https://linker.org/", '<a href="http://bad.net/">x</a>'), (8, None, html), (9, "no scheme", html), (10, "http://notcom/", ""), (10, "http://x.com", "")]
    got = sorted(tuple(r)[:5] for r in url_filters.judged(spark.createDataFrame(urls, "page_id bigint, url string, html string")).collect())
    want = [(1, "a.com", "/x", "com/", "allow"), (2, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (3, "m.example.com", "/en/1", "example.com/en/", "block"), (4, "bad.net", "/es/1", "net/es/", "block"), (5, "bad.net", "/fr/", "net/fr/", "block")]
    assert got[:5] == want
    verdict = {(r[0], r[1]): r[4] for r in got}
    assert verdict[(8, "")] == verdict[(9, "")] == verdict[(10, "notcom")] == "allow"
    assert verdict[(6, "bad.net")] == "block"  # most of the host is blocked
    assert verdict[(7, "linker.org")] == "allow"  # a.com links there too and takes half: 0.85 * 1/2 * 2/3 is under the threshold
    alone = [u for u in urls if u[0] not in (1, 8, 9)]  # nobody else links there: 0.85 * 2/3
    got = url_filters.judged(spark.createDataFrame(alone, "page_id bigint, url string, html string")).collect()
    assert {r.verdict for r in got if r.page_id == 7} == {"block"}
    ranks = url_filters.propagate(spark.createDataFrame([("t", 1.0, 0.0), ("b", 0.0, 1.0)], "host string, trust0 double, distrust0 double"), spark.createDataFrame([("t", "m", 1.0), ("l", "b", 1.0)], "src string, dst string, weight double"))
    got = {r.host: (round(r.trust, 3), round(r.distrust, 3)) for r in ranks.collect()}
    assert got == {"t": (1.0, 0.0), "b": (0.0, 1.0), "m": (0.85, 0.0), "l": (0.0, 0.85)}
    assert url_filters.judged(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_url_filters_by_brute_force(spark):
    """Verdicts of a random web of 60 hosts against dense iteration; hosts in mixed case, with user and port, links to itself."""
    rnd = random.Random(21)
    hosts = [f"h{i}.{rnd.choice(['net', 'com', 'org'])}" for i in range(60)]
    pages = []
    for i in range(300):
        host = rnd.choice(hosts)
        out = rnd.sample(hosts, rnd.randint(0, 3))
        html = "".join(f'<a HREF="{rnd.choice(["https:", "http:", ""])}//{o.upper() if rnd.random() < 0.3 else o}/p">' for o in out) + ' <a href="/here"> <img src=x.png>'
        pages.append((i, f"https://{host.upper() if i % 5 == 0 else host}{rnd.choice(['/es/a', '/fr/b', '/de/c', ''])}", None if i % 17 == 0 else html, out if i % 17 else [], host))
    rule = lambda h, u: "allow" if h.endswith(".com") and u.count("/") > 2 else "block" if h.endswith(".net") and ("/es/" in u or "/fr/" in u) else None
    n, at = len(hosts), {h: i for i, h in enumerate(hosts)}
    t0, d0, of, link = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, n))
    for _, url, _, out, host in pages:
        says, i = rule(host, url), at[host]
        t0[i], d0[i], of[i] = t0[i] + (says == "allow"), d0[i] + (says == "block"), of[i] + 1
        for o in set(out) - {host}:
            link[i, at[o]] += 1
    t0, d0 = t0 / np.maximum(of, 1), d0 / np.maximum(of, 1)
    down, up = link / np.maximum(link.sum(axis=1, keepdims=True), 1e-300), link / np.maximum(link.sum(axis=0, keepdims=True), 1e-300)
    trust, distrust = t0, d0
    for _ in range(200):
        trust, distrust = t0 + 0.85 * down.T @ trust, d0 + 0.85 * up @ distrust
    assert min(abs(distrust - 0.5)) > 1e-3
    want = {i: rule(h, u) or ("block" if distrust[at[h]] >= 0.5 and distrust[at[h]] > trust[at[h]] else "allow") for i, u, _, _, h in pages}
    got = {r.page_id: r.verdict for r in url_filters.judged(spark.createDataFrame([p[:3] for p in pages], "page_id bigint, url string, html string")).collect()}
    assert got == want and len({v for (i, v) in want.items() if rule(pages[i][4], pages[i][1]) is None}) == 2


def test_url_filters_converge(spark):
    """Two hosts that link only each other get all that comes round, and what is many links away counts."""
    starts = spark.createDataFrame([("x", 0.0, 0.0), ("y", 0.0, 0.165)], "host string, trust0 double, distrust0 double")
    edges = spark.createDataFrame([("x", "y", 1.0), ("y", "x", 1.0)], "src string, dst string, weight double")
    got = {r.host: r.distrust for r in url_filters.propagate(starts, edges).collect()}
    assert got["x"] == pytest.approx(0.165 * 0.85 / (1 - 0.85**2), abs=1e-3) and got["x"] > url_filters.THRESHOLD
    starts = spark.createDataFrame([("h0", 1.0, 0.0)], "host string, trust0 double, distrust0 double")
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(24)], "src string, dst string, weight double")
    got = {r.host: r.trust for r in url_filters.propagate(starts, edges).collect()}
    assert all(got[f"h{i}"] == pytest.approx(0.85**i) for i in range(25))


def test_topk(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice((-0.5, 0.0, 0.25, 0.75)) for _ in range(4)]) for i in range(230)]
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0]), (400, [float("nan")] * 4), (500, [0.0] * 4), (600, [1.0, 1.0]), (601, [1.0, -1.0]), rows[3], (None, [1.0] * 4), (700, [float("inf")] * 4)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = topk.top_k(df.where("vec_id % 100 = 0"), df, shard_rows=64, block_queries=2).collect()
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in [x for x in good if x[0] % 100 == 0]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op5_topk_search", "op8_chat_format", "op10_jaccard_join"])
def test_sql(spark, sf_dir, name):
    from pagelens.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    assert sorted(map(tuple, queries.QUERIES[name](spark, sf_dir).select(*want.columns).collect())) == sorted(want.fetchall())


def test_mixing(docs, empty):
    rows = mixing.copies(docs).collect()
    size = collections.Counter()
    for _, t, _, s, *_ in ROWS:
        size[s] += len(split(t))
    order = sorted((s for s in size if s is not None), key=lambda s: s) + ([None] if None in size else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * size[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    by_id = collections.defaultdict(list)
    for i, t, _, s, *_ in ROWS:
        by_id[i].append((len(split(t)), size[s], s))
    taken = collections.Counter()
    for r in rows:
        n, whole, s = by_id[r.doc_id][0]
        assert (r.size, r.source_size) == (n, whole) and r.target == pytest.approx(target[s]) and 0 <= r.copies <= 3
        taken[s] += r.copies * r.size
    longest = max(len(split(t)) for _, t, *_ in ROWS)
    assert len(rows) == len(ROWS) and all(abs(taken[s] - target[s]) <= longest for s in size)
    assert sorted((r.doc_id or -1, r.copies) for r in rows) == sorted((r.doc_id or -1, r.copies) for r in mixing.copies(docs).collect())
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.copies(empty).count() == mixing.mixed(empty).count() == 0


def test_lm(docs, empty):
    counts = collections.Counter()
    tokens = lambda t: [*(x.lower() for x in split(t)), None]
    for i, t, *_ in ROWS:
        if not lm_scoring.held_out(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), lm_scoring.held_out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, *_ in ROWS)
    got = lm_scoring.scored(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.scored(empty).count() == 0


def test_lm_beats_base_on_held_out(spark, sf_dir):
    got = lm_scoring.op7_lm_scoring(spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_lm_sums_to_one():
    """Over all known words and the unseen event, after any history and with any weights."""
    rng = np.random.default_rng(7)
    words = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    count, near = rng.integers(1, 200, 300), rng.integers(0, lm_scoring.CLUSTERS, 300).astype(np.uint8)
    at = (near.astype(np.int64) * lm_scoring.BANDS + lm_scoring._band(count)) * lm_scoring.BINS + lm_scoring._bin(lm_scoring._cell(words))
    n = lm_scoring.CLUSTERS * lm_scoring.BANDS * lm_scoring.BINS
    top = [(int(words[i]), int(near[i]), int(count[i])) for i in np.argsort(-count)[:20]]
    v = lm_scoring.Vocabulary(top, np.bincount(at, count, n).astype(np.int64), np.bincount(at, minlength=n))
    assert (v.train_tokens, v.known_words) == (count.sum(), 300)
    cls, _, share = v.classes(np.append(words, np.uint64(0)), np.append(count, 0), np.append(near, 0).astype(np.uint8))
    weights = lm_scoring.Weights(rng.normal(0, 1, len(lm_scoring.Weights().flat)).astype(np.float32))
    for _ in range(5):
        f = np.repeat(np.array([[rng.integers(4096), 4096 + rng.integers(4096), 8192 + rng.integers(4096)]], np.int32), 301, axis=0)
        log = lm_scoring.log_probability(weights, v, f, cls.astype(np.int64), lm_scoring._bin(lm_scoring._cell(np.append(words, np.uint64(0)))))
        assert (10 ** (log + share)).sum() == pytest.approx(1, abs=1e-4)


def test_lm_learns_nothing_from_held_out(spark, docs):
    """With other texts, languages and sizes of held-out documents all other scores stay."""
    held = F.udf(lm_scoring.held_out, "boolean")("doc_id")
    other = docs.withColumn("text", F.when(held, F.lit("w1 w2 w3 quite other words")).otherwise(F.col("text"))).withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    one, two = (sorted((str(r.doc_id), r.n_tokens, r.train_tokens, r.base_score, r.score) for r in lm_scoring.scored(x.coalesce(1)).where("not held_out").collect()) for x in (docs, other))
    assert one == two and len(one) > 20


def thue_morse(n):
    """Words that a polynomial hash modulo 2**64 takes for one, whatever its base: letters by the parity of a place's bits, and the same turned round."""
    return tuple("".join("ab"[(i.bit_count() + turn) % 2] for i in range(n)) for turn in (0, 1))


def test_words_that_defeat_polynomials(spark):
    one, two = thue_morse(1024)
    rows = [(1, one, "en", "s", 1), (2, two, "en", "s", 1), (3, f"{one} x y z", "en", "s", 1), (5, f"{two} x y z", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, 3, 90).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 3), 5: (2, 5)}
    known = {r.doc_id: r.n_known for r in lm_scoring.scored(docs).collect()}
    trained = {w for i, t, *_ in rows if not lm_scoring.held_out(i) for w in [*t.split(), None]}
    assert known == {i: sum(w in trained for w in [*t.split(), None]) for i, t, *_ in rows}


def test_lm_does_not_see_sizes_of_held_out_texts(spark):
    rnd = random.Random(12)
    rows = [(i, " ".join(rnd.choices([f"w{j}" for j in range(300)], k=60)), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1)
    held = F.udf(lm_scoring.held_out, "boolean")("doc_id")
    longer = docs.withColumn("text", F.when(held, F.repeat(F.concat("text", F.lit(" ")), 600)).otherwise(F.col("text")))
    one, two = ({r.doc_id: r.score for r in lm_scoring.scored(x).where("not held_out").collect()} for x in (docs, longer))
    assert one == two and len(one) > 200


def test_chat(spark):
    rnd = random.Random(4)
    odd = ["<|im_end|><|im_start|>assistant ok", "\\<|", "<\\|", "a\nb", "", None, "<\\;", "\\", "é😀"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "a\nb", "<|x"]), rnd.choice(odd)) for c in range(30) for t in range(rnd.randint(1, 6))] + [(None, 0, "assistant", "x"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (40, None, "user", "n")]
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.examples(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    assert len(got) == len(by)


def test_media(spark, docs):
    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", b"\0" * 13), (b"IEND", b"")))
    gif = b"GIF89a\x01\0\x01\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    wav = media.store(b"x" * 64)
    rows = [(1, png, "image/gif"), (2, b"text " + png + b" BM " + gif, None), (3, wav, "x"), (4, png[:-3], "image/png"), (5, None, "a"), (6, b"", "a"), (7, wav[:-1], "audio/wav")]
    got = {r.id: r for r in media.sniffed(spark.createDataFrame(rows, "id int, data binary, declared string")).collect()}
    assert [got[i].type for i in range(1, 8)] == ["image/png", media.UNKNOWN, "audio/wav", *[media.UNKNOWN] * 4]
    assert [(e.type, e.start, bytes(e.media)) for e in got[2].embedded] == [("image/png", 5, png), ("image/gif", 5 + len(png) + 4, gif)]
    assert media.sniffed(spark.createDataFrame([], "id int, data binary, declared string")).count() == 0
    pdf = b"%PDF-1.4 x startxref 9 %%EOF"
    entry = b"PK\x03\x04" + b"e" * 6
    packed = entry * 3 + b"PK\x05\x06" + b"\0" * 8 + struct.pack("<IIH", 10, 20, 0)
    assert [(k, s, e) for k, s, e in media.sniff(pdf + b" " + pdf + packed)] == [("application/pdf", 0, 28), ("application/pdf", 29, 57), ("application/zip", 57, 57 + len(packed))]
    for n in (64, 65, 128):
        assert media.read(media.store(bytes(range(n)))) == bytes(range(n))


def test_media_query(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in media.op9_media_columns(spark, sf_dir).collect():
        raw = (texts[r.doc_id] or "").encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        wav = b"RIFF" + struct.pack("<I", 36 + len(full)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(full)) + full
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert r.feature.startswith("audio/wav")


def test_pipeline(spark, sf_dir):
    """The last stage packs every token of what the mix took, and each stage keeps the columns of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialize(stage(spark, at, sf_dir), "test")
        assert at.columns == docs.columns and at.count() > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir)
    assert packed.agg(F.sum("length")).first()[0] > at.agg(F.sum(mixing.word_count("text"))).first()[0]


def brute_windows(rows, k=13):
    """Of rows (doc_id, text): the kept words of each, by windows that also start under a smaller doc_id."""
    seen = {}
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - k + 1):
            if i is not None:
                seen[tuple(w[j : j + k])] = min(seen.get(tuple(w[j : j + k]), i), i)
    out = []
    for i, t in rows:
        w, gone = split(t), set()
        for j in range(len(w) - k + 1):
            if i is not None and seen[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        out.append((i, b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def test_pipeline_stages_by_brute_force(docs, empty):
    """Each stage on what the one before it kept, over nulls, repeats, ties and columns whose names clash; and on an empty table."""
    from tokenizers import Tokenizer

    odd = {"key": F.lit(1), "rows": F.lit("r"), "copies": F.lit(9), "turn": F.lit(2), "a.b": F.lit("dot"), "component_id": F.lit(0), "node": F.lit(0), "host": F.lit("h"), "prior": F.lit(0.5), "bucket": F.lit(3), "m": F.create_map(F.lit("k"), F.lit("v"))}
    at = corpus_pipeline.materialize(docs.withColumns({k: v for k, v in odd.items() if "." not in k}).withColumn("a.b", odd["a.b"]), "odd")
    run = lambda i: corpus_pipeline.materialize(corpus_pipeline.STAGES[i][1](docs.sparkSession, at, ""), "odd")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    names, kept = at.columns, run(0)
    assert kept.columns == names and pairs(kept) == [(i, t) for i, t in pairs(at) if t and any(c.isalpha() for c in t)]
    at = kept
    sets, _, find = brute_jaccard(pairs(at), 5, 80)
    kept = run(1)
    assert kept.columns == names and pairs(kept) == [(i, t) for i, t in pairs(at) if i is None or find(i) == i]
    at = kept
    want = brute_windows(pairs(at))
    kept = run(2)
    assert kept.columns == names and pairs(kept) == sorted(want, key=str) and all(r.n_chars == len(r.text) for r in kept.collect())
    at = kept
    kept = run(3)
    before, after = collections.Counter(pairs(at)), collections.Counter(pairs(kept))
    assert kept.columns == names and set(after) <= set(before) and all(n <= 3 * before[x] for x, n in after.items())
    of = {r.doc_id: r.source for r in at.collect()}
    words, target = collections.Counter(), {of[r.doc_id]: r.target for r in mixing.copies(at).collect()}
    for r in kept.collect():
        words[r.source] += len(split(r.text))
    longest = max(len(split(t)) for _, t in before)
    assert all(abs(words[s] - t) <= longest for s, t in target.items())
    at = kept
    whole = Tokenizer.from_file(packing.vocabulary_path())
    tokens = sorted(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs(at))
    assert sorted(r.doc_tokens for r in run(4).where("start = 0").collect()) == tokens
    at = empty
    for i in range(5):
        at = run(i)
        assert at.count() == 0


def test_substring_dedup_of_a_passage_in_every_document(spark, monkeypatch):
    """Buckets that settle often give what one pass gives."""
    rnd = random.Random(31)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{' '.join(rnd.choices('abcdefgh', k=rnd.randint(0, 9)))} {passage} {rnd.random()}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    parts = list(df.coalesce(1).mapInArrow(substring_dedup._deal(13, 1), "bucket int, slices binary").collect())
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup, "_SETTLE", 100)
    batch = pa.RecordBatch.from_arrays([pa.array([r.bucket for r in parts]), pa.array([bytes(r.slices) for r in parts], pa.binary())], ["bucket", "slices"])
    out = next(iter(substring_dedup._count(13)(iter([batch])))).to_pydict()
    gone = {d: {x for a, b in zip(s, e) for x in range(a, b)} for d, s, e in zip(out["_pl_doc"], out["_pl_start"], out["_pl_end"])}
    want = {i: kept for i, kept in brute_windows(rows)}
    assert all(" ".join(w for j, w in enumerate(t.split()) if j not in gone.get(i, ())) == want[i] for i, t in rows)
    assert len(want[5].split()) < 12 and len(want[0].split()) > 39


def test_packing_spreads_equal_rows(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    got = packing.pack(rows, group_docs=60).selectExpr("shiftright(sequence_id, 32) AS g").groupBy("g").count().collect()
    assert len(got) > 40 and max(r["count"] for r in got) < 150


def test_sketches_keep_links():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    for size in (3, 70, 700):
        base = rng.integers(0, 1 << 62, size, dtype=np.uint64)
        other = np.append(np.where(rng.random(size) < 0.1, base + np.uint64(1), base), rng.integers(0, 1 << 62, 40, dtype=np.uint64))
        sets = [np.unique(x) for x in (base, other, base + np.uint64(7), base)]
        made = jaccard_join._sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
        pairs = [(a, b) for a in range(4) for b in range(a)]
        cols = [[x[p[s]] for p in pairs] for x in (list(map(len, sets)), made) for s in (0, 1)]
        batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), *map(pa.array, cols)], ["a", "b", "n_a", "n_b", "sketch_a", "sketch_b"])
        kept = next(iter(jaccard_join._near_sketches(80)([batch]))).to_pydict()
        kept = set(zip(kept["a"], kept["b"]))
        likely = {(a, b) for a, b in pairs if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
        assert likely <= kept and (3, 0) in likely
        assert size < 10 or (2, 0) not in kept


def test_lm_step_by_brute_force():
    rnd = np.random.default_rng(11)
    for columns, width, n in ((3, 50, 700), (4, 32, 300), (3, 50, 1)):
        w = rnd.normal(size=(3 * lm_scoring.CELLS + 60, width)).astype(np.float32)
        sq = rnd.random(w.shape).astype(np.float32)
        f = np.minimum(rnd.zipf(1.3, (n, columns)), lm_scoring.CELLS) - 1 + np.arange(columns) * lm_scoring.CELLS
        f[:, columns - 1] = np.minimum(f[:, columns - 1], len(w) - 2)
        f, target = f.astype(np.int32), rnd.integers(0, width, n)
        want, squares, g = w.astype(float), sq.astype(float), collections.defaultdict(float)
        for x, t in zip(f, target):
            z = want[x].sum(axis=0) + (want[-1] if columns == 3 else 0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[t] -= 1
            for row in (*x.tolist(), *([len(w) - 1] if columns == 3 else [])):
                g[row] = g[row] + p
        for row, x in g.items():
            squares[row] += x * x
            want[row] -= lm_scoring.RATE * x / np.sqrt(squares[row] + 1)
        lm_scoring._step(w, sq, f, target)
        assert np.allclose(w, want, atol=1e-4) and np.allclose(sq, squares, rtol=1e-3, atol=1e-3)
    far = np.array([[0, -500, 90], [-300, -310, -305], [0, 0, 0]], np.float32)  # rows far apart in one batch
    right = np.array([1, 2, 0])
    exact = [float(far[i, r] - far[i].max() - np.log(np.exp((far[i] - far[i].max()).astype(float)).sum())) for i, r in enumerate(right)]
    assert np.allclose(lm_scoring._log_softmax(far.copy(), right), exact, rtol=1e-5)


def test_lm_features_stay_within_a_document():
    cells = np.arange(100, 110, dtype=np.uint32)
    sizes = [1, 1, 4, 1, 3]  # an empty text has its end token alone
    begin = np.cumsum([0, *sizes[:-1]])
    apart = [lm_scoring._features(cells[b : b + n], np.array([0])) for b, n in zip(begin, sizes)]
    assert (lm_scoring._features(cells, begin) == np.concatenate(apart)).all()


def test_dedup_bucket_holds_few_bytes_a_word():
    rnd, vocabulary = random.Random(1), [f"w{i}" for i in range(5000)]
    texts = [" ".join(rnd.choices(vocabulary, k=200)).encode() for _ in range(600)]
    ids, blobs = np.arange(600), []
    for i in range(0, 600, 100):
        blobs += [x for _, x in substring_dedup._slices(ids[i : i + 100], ids[i : i + 100], substring_dedup.Words(texts[i : i + 100]), 13, 1)]
    words = sum(int(substring_dedup._decode(x)[1]["count"].sum()) for x in blobs)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "slices"])
    tracemalloc.start()
    list(substring_dedup._count(13)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 42 * words
