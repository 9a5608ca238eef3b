"""SimHash groups, against shingles hashed one by one and all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash

DOCS = "doc_id bigint, text string"


def print_of(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    own = [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(prints, bits=2):
    """{id: smallest id reached} of (id, fingerprint) rows; ids without a number are left out."""
    known = [(i, p) for i, p in prints if i is not None]
    return roots([(a, b) for n, (a, x) in enumerate(known) for b, y in known[:n] if (x ^ y).bit_count() <= bits], {i for i, _ in known})


def check(spark, rows):
    got = simhash.groups(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    prints = [(i, print_of(t)) for i, t in rows]
    want = brute(prints)
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, f"{p:016x}", want.get(i))) for i, p in prints)


def test_groups_by_brute_force(spark, rng):
    rows = []
    for n in (3, 40, 300):
        words = [f"v{rng.randrange(4000)}" for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 9):
            own = list(words)
            for _ in range(edits):
                own[rng.randrange(n)] = f"new{rng.randrange(10**6)}"
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, "\n\t".join(own).upper())]
    check(spark, rows + [(900, "one"), (901, "ONE "), (902, "two words"), (903, None), (904, " \n"), (905, "")])


def test_groups_of_odd_tables(spark, odd, empty, wide):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(spark, rows)
    assert simhash.groups(empty).count() == 0
    assert sorted(map(str, simhash.groups(wide).collect())) == sorted(map(str, simhash.groups(odd).collect()))


def test_rows_of_one_id_join_what_their_texts_join(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    check(spark, [(5, texts[0]), (9, texts[0]), (9, texts[1]), (7, texts[1]), (8, texts[2]), (7, texts[2]), (7, texts[2]), (None, texts[0])])


def crowd(spark, values, bits, tmp):
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)), i) for i, v in enumerate(values)], "print bigint, head bigint").withColumn("n", F.lit(1))
    return [(r["a"], r["b"]) for r in simhash._links(frame, bits, tmp).collect()]


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("limit", [2, 64, 10_000])
def test_links_of_posts_and_crowds(spark, rng, monkeypatch, bits, limit):
    """Fingerprints beside a few centres, in posts of any size: components are those of all pairs."""
    from tidemark.llm.scratch import Scratch

    monkeypatch.setattr(simhash, "CROWD", limit)
    values = {0, (1 << 64) - 1}
    for centre in (rng.getrandbits(64), 0):
        for _ in range(130):
            value = centre
            for _ in range(rng.randrange(7)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
    values = sorted(values)
    links = crowd(spark, values, bits, Scratch(spark, "t"))
    assert all((values[a] ^ values[b]).bit_count() <= bits for a, b in links)
    assert roots(links, range(len(values))) == brute(list(enumerate(values)), bits)


def test_hot_classes_meet_by_a_broadcast(spark, monkeypatch):
    from tidemark.llm import skew

    monkeypatch.setattr(skew, "FEW", 3)
    monkeypatch.setattr(skew, "SHARE", 10)
    rows = [(i, "the same few words") for i in range(40)] + [(100 + i, f"other text number {i} of all") for i in range(30)] + [(None, "the same few words")]
    check(spark, rows)
