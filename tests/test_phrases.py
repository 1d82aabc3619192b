"""The automaton of many phrases against the literal plan and against plain search."""

import dataclasses
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelens.operators import heuristics as H
from pagelens.operators import phrases as P
from pagelens.sources.captures import captures
from pagelens.sources.rules import RULES


def rows(df):
    return sorted(map(str, df.collect()))


def test_same_as_literals(spark, sf_dir):
    caps = captures(spark, sf_dir)
    assert rows(H.lexicon(caps)) == rows(H.lexicon(caps, literal_rules=0)) != []
    assert rows(H.brand(caps)) == rows(H.brand(caps, literal_rules=0)) != []
    low = H.prepared(caps).select("scan_id", "low")
    assert rows(low.select("scan_id", H.currency_found())) == rows(low.select("scan_id", H.currency_found(literal_rules=0)).toDF(*low.select("scan_id", H.currency_found()).columns))


def test_against_plain_search(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("ab_é -\n", k=rnd.randint(0, 40))) for _ in range(300)] + [None, ""]
    words = sorted({"".join(rnd.choices("ab_é -", k=rnd.randint(1, 4))) for _ in range(60)}) + ["", "a", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for whole in (False, True):
        got = df.select("id", P.found("t", words, pa.array(range(len(words)), pa.int32()), "int", whole).alias("f")).collect()
        for r in got:
            text = texts[r.id]
            want = [i for i, w in enumerate(words) if text is not None and (w in text if not whole else w != "" and re.search(rf"\b{re.escape(w)}\b", text))]
            assert r.f == want, (text, whole)


def test_many_phrases(spark, sf_dir):
    caps = captures(spark, sf_dir).select("scan_id", "url", F.repeat("html", 3).alias("html"), "headers", "requests").persist()
    rnd = random.Random(9)
    more = tuple((f"r{i}", "many", "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=14)), "low", 1) for i in range(100_000))
    took = []
    for extra in (more[:10], more):
        rules = dataclasses.replace(RULES, lexicon=RULES.lexicon + extra, ph_brands=RULES.ph_brands + tuple(x[2] for x in extra))
        H.lexicon(caps, rules, 0).count()
        began = time.time()
        got = H.lexicon(caps, rules, 0)
        assert got.where("category != 'scam_many'").count() == H.lexicon(caps).count()
        took.append(time.time() - began)
        assert rows(H.brand(caps, rules, 0)) == rows(H.brand(caps))
    assert took[1] < 20 * took[0] + 20  # 10,000 times the rules: what grows is building the automaton
    with pytest.raises(ValueError, match="too many"):
        P.found("t", ["x" * (1 << 20)] * 130, pa.array(range(130), pa.int32()), "int")
