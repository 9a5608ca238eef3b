"""Importance resampling, against dictionaries and one sort."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import resampling as rs
from tidemark.llm.scratch import Scratch

DOCS = "doc_id bigint, text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, target, percent=25, least=20):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10_000) / ((a + 1) * (T + 10_000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        words, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    drawn = sorted((-r[3], r[0] is None, r[0] or 0) for r in rows if r[4])
    drawn = drawn[: percent * len(drawn) // 100]
    ranks = {}
    for place, (score, _, i) in enumerate(drawn, 1):
        ranks.setdefault((i if i else None, -score), []).append(place)
    return rows, ranks


def check(spark, docs, target, parts=4):
    got = rs.resample(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    rows, ranks = brute(docs, target)
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, (r[:4] for r in rows)))
    found = {}
    for r in got:
        if r["rank"] is not None:
            found.setdefault((r["doc_id"], r["score"]), []).append(r["rank"])
    assert {k: sorted(v) for k, v in found.items()} == ranks


def texts(rng, n):
    words = [f"w{i}" for i in range(300)] + ["é日本", "Zürich", "don't", "x-y", "A1b2", "q" * 80, "Q" * 200 + "z"]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 19, 20, 40, 200])))) for i in range(n)]


def test_resampling_by_brute_force(spark, rng):
    docs = texts(rng, 700)
    check(spark, docs, [docs[i][1] for i in range(0, 40, 3)] + [None, ""], parts=9)


def test_ties_repeats_and_odd_tables(spark, odd, empty, wide, rng):
    target = spark.createDataFrame([("the quick brown fox",)], "text string")
    docs = texts(rng, 30) + [(None, " ".join(["w1"] * 30))] * 7 + [(3, " ".join(["w2"] * 25))] * 200
    check(spark, docs, ["w1 w1 w2"], parts=7)
    check(spark, docs, [])
    check(spark, [(1, "a b"), (2, None)], ["a"])
    check(spark, [(r["doc_id"], r["text"]) for r in odd.collect()], ["line two"])
    assert rs.resample(empty, target).count() == 0
    same = lambda df: sorted(map(str, df.collect()))
    assert same(rs.resample(wide, target)) == same(rs.resample(odd, target))


def test_many_ranges_and_the_exact_count(spark):
    """Equal keys by the hundred are cut into ranges too, and every rank is given once."""
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 5, id) as doc_id", "repeat('w ', 30) as text").repartition(11)
    got = rs.resample(docs, docs.limit(0), scratch=Scratch(spark, "t")).where("rank is not null").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 751))
    order = sorted(got, key=lambda r: r["rank"])
    assert [(-r["score"], r["doc_id"]) for r in order] == sorted((-r["score"], r["doc_id"]) for r in order)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3)), max_size=8), max_size=9))
def test_tournament_merges_sorted_runs(runs):
    runs = [sorted(r) for r in runs]
    assert [runs[i][j] for i, j in rs.Tournament(runs)] == sorted(k for r in runs for k in r)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=90), min_size=1, max_size=12), st.integers(0, 2**32 - 1))
def test_crc32_of_spans(spans, start):
    data = np.frombuffer(b"".join(spans), np.uint8)
    size = np.array([len(s) for s in spans])
    got = rs.crc32_spans(data, np.cumsum(size) - size, size, np.full(len(spans), start, np.uint32))
    assert got.tolist() == [zlib.crc32(s, start) for s in spans]


@pytest.mark.parametrize("text", ["", "A", "a\x00b", "é", "z{", "Don't stop"])
def test_words_are_those_of_the_pattern(text):
    data = np.frombuffer(text.encode(), np.uint8)
    n, _, one, two = rs.features(data, np.array([0, len(data)]))
    words, own = features(text)
    assert n[0] == len(words) and [*one.tolist(), *two.tolist()] == [zlib.crc32(f.encode()) for f in own]
