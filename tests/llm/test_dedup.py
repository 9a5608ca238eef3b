"""Near-duplicate groups, line dedup, components, nearest neighbours."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import ann, graph, kernels, lines, near_dup, skew
from tidemark.llm.scratch import Scratch

DOCS = "doc_id bigint, text string"


def union(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_by_brute_force(spark, rng):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == union(real, {n for e in real for n in e})
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "t")).count() == 0


def test_tables_go_when_they_are_told_to(spark, tmp_path):
    import os

    from tidemark.llm import scratch as sc

    with sc.collected() as made:
        own = Scratch(spark, "goes")
        a, b = own.keep(spark.range(3), "a"), own.keep(spark.range(4), "b")
    place = own.folder.removeprefix("file://")
    assert made == [own] and len(os.listdir(place)) == 2
    own.drop(a, spark.range(1))
    assert len(os.listdir(place)) == 1 and b.count() == 4
    own.clear()
    assert not os.path.exists(place)


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, k, percent=80):
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return union(links, {i for i, _ in sets})


def check_groups(spark, rows, k):
    got = near_dup.groups(spark.createDataFrame(rows, DOCS), k=k).collect()
    assert len(got) == len(rows)
    want = brute(rows, k)
    assert all((r["component_id"], r["kept"]) == (want.get(r["doc_id"]), r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"]) for r in got)
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"]) for r in got))) == sorted(map(str, ((i, len(shingle_set(t, k))) for i, t in rows)))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("k", [2, 5])
def test_groups_by_brute_force(spark, rng, k):
    rows, base = [], [[f"v{rng.randrange(5000)}" for _ in range(n)] for n in (30, 80, 200)]
    for words in base:
        for edits in (0, 0, 1, 2, 3, 4, 6, 8, 10, 12):
            rows += [(len(rows) + j, edited(rng, words, edits)) for j in range(4)]
    rows += [(1000 + i, f"x{i} y{i} z{i}") for i in range(30)] + [(2000, "A b"), (2001, "a B"), (2002, "one"), (2003, "ONE"), (2004, ""), (2005, None)]
    check_groups(spark, rows, k)


def test_many_members_apart_from_their_centre(spark, rng):
    """A crowd around one text, most of it not similar to each other, with a few links beside the centre."""
    words = [f"v{i}" for i in range(150)]
    rows = [(i, edited(rng, words, rng.choice([2, 4, 6, 9, 11]))) for i in range(150)]
    for i in range(0, 150, 15):
        rows.append((1000 + i, edited(rng, rows[i][1].split(), 3)))
    check_groups(spark, rows, 2)


def test_groups_of_odd_tables(spark, odd, empty, wide):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_groups(spark, rows, 5)
    assert near_dup.groups(empty).count() == 0
    stays = near_dup.keep_first(wide)
    assert stays.columns == wide.columns
    ids = sorted(str(r["doc_id"]) for r in stays.select("doc_id").collect())
    assert ids == sorted(map(str, [1, 3, 4, 5, 6, 7, 9, 10, 12, 13, 13, None, None, None]))


def test_one_row_of_a_group_stays_whatever_its_id(spark):
    """Null and shared ids: a row goes for its own text only, and a row with an id goes before one without."""
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, long), (None, long + " end"), (None, other), (None, other), (7, long), (7, "its own few words here"), (7, "its own few words here"), (3, other + " x"), (None, None), (None, ""), (9, " "), (9, " ")]
    for n in (1, 4):
        got = near_dup.keep_first(spark.createDataFrame(rows, DOCS).repartition(n)).collect()
        assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(7, long), (7, "its own few words here"), (3, other + " x"), (None, None), (None, ""), (9, " "), (9, " ")])


def test_salted_joins(spark, rng, monkeypatch):
    monkeypatch.setattr(near_dup, "BUCKET_SALT", 3)
    monkeypatch.setattr(near_dup, "CENTRE_SALT", 2)
    test_many_members_apart_from_their_centre(spark, rng)


def test_very_long_text_in_bounded_memory():
    """The words of a text of 24 MB, and its sketch, take a few times the text, whatever its words."""
    import resource

    rng = np.random.default_rng(1)
    text = rng.choice(np.frombuffer(b"abcdefgh     ", np.uint8), 24 << 20)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    words, places = kernels.word_hashes(text, np.array([0, len(text)]))
    sets, at = kernels.shingles(words, places, 2)
    kernels.superminhash(sets, at, 80)
    assert len(words) == len(text.tobytes().split()) and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_200_000
    small, cut = text[:5000], np.array([0, 5000])
    whole = kernels.word_hashes(small, cut)[0].tolist()
    kernels.WINDOW_BYTES, kept = 64, kernels.WINDOW_BYTES
    try:
        assert kernels.word_hashes(small, cut)[0].tolist() == whole
    finally:
        kernels.WINDOW_BYTES = kept


def test_partitioning_changes_nothing(spark, odd):
    one, many = (sorted(map(str, near_dup.groups(odd.repartition(n)).collect())) for n in (1, 13))
    assert one == many


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)))
    for n in (400, 20):
        x, y = a[:n], b[300 - 3 * n // 4 : 300 + n - 3 * n // 4] if n == 400 else np.concatenate((a[:15], b[300:305]))
        signatures = kernels.superminhash(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]), 512)
        assert (signatures >> np.uint64(48)).max() < 512
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((signatures[0] == signatures[1]).mean() - true) < 0.08


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té", max_size=12), max_size=6))
def test_words_of_slices(texts):
    import pyarrow as pa

    data = pa.array(texts, pa.string())
    seen = {}
    for first, end, raw, offsets in kernels.text_slices(data):
        hashes, places = kernels.word_hashes(raw, offsets)
        for i in range(end - first):
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[first + i].replace("B", "b"))
            own = hashes[places[i] : places[i + 1]]
            assert len(own) == len(words)
            for w, h in zip(words, own.tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# lines


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def line_brute(rows, shortest=0):
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    judged = sorted(((i, n, x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)), key=lambda r: order(r[:2]))
    first = {}
    for i, n, x in judged:
        first.setdefault(x, (i, n))
    want = {}
    for i, n, x in judged:
        near = [p for y, p in first.items() if len(x) >= shortest and len(y) >= shortest and one_edit(x, y) and order(p) < order(first[x])]
        equal = first[x] if first[x] != (i, n) else None
        want[i, n] = min(near, key=order) if near else equal
    return want


@pytest.mark.parametrize("shortest", [0, 20])
def test_lines_by_brute_force(spark, rng, shortest, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 5)
    monkeypatch.setattr(skew, "SHARE", 50)
    base = ["".join(rng.choice("abcd e") for _ in range(n)) + "." for n in (1, 2, 5, 19, 20, 21, 40, 90)]
    rows = []
    for i in range(60):
        text = []
        for x in [*rng.sample(base, 3), "a line of all texts"]:
            for _ in range(rng.choice([0, 0, 1, 1, 2]) if x[:6] != "a line" else 0):
                at, how = rng.randrange(len(x)), rng.randrange(3)
                x = x[:at] + ["", "z", "é" + x[at]][how] + x[at + 1 :]
            text.append(x)
        rows.append((i, "\n".join(text)))
    rows += [(None, base[4]), (70, None), (71, ""), (72, "\n \n"), (73, base[4] + "\n" + base[4])] + rows[5:7]
    rows += [(80, "Subscribe now!"), (81, "Subscribe now?"), (82, "a"), (83, "b"), (84, "ab"), (85, "é")]
    got = {(r["doc_id"], r["line_no"]): None if r["kept"] else (r["keeper_doc_id"], r["keeper_line_no"]) for r in lines.judge(spark.createDataFrame(rows, DOCS), min_chars=shortest).collect()}
    want = line_brute(rows, shortest)
    assert got == want


def test_lines_of_odd_tables(spark, odd, empty, wide):
    out = lines.drop_repeats(wide)
    assert out.columns == wide.columns and out.count() == wide.count()
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert texts[4] == (None, None) and texts[5] == ("", 0) and texts[6][0] == " \n\t \n"
    assert texts[1] == texts[2] == texts[3] == ("", 0)  # the row without an id comes first
    assert texts[12][0] == "\nother words follow here to the end"
    assert lines.judge(empty).count() == 0 and lines.drop_repeats(empty).count() == 0


def test_lines_of_texts_that_share_an_id(spark):
    """Texts without an id, and of one id, of different lengths: a repeat in one takes no line out of another."""
    line = "The quick brown fox jumps over the lazy dog again and again"
    longer = "\n".join(["a line of the longer text", "another one of its own", line, "its fourth line", line + "s", "its last line"])
    rows = []
    for i in (None, 5):
        x = f" of {i}"
        rows += [(i, line), (i, "short and unique" + x), (i, longer.replace(" its", f" its{x}")), (i, f"first{x}\nsecond{x}\n{x} third, alone")]
    docs = spark.createDataFrame(rows, DOCS)
    shuffled = docs.repartition(1).sortWithinPartitions(F.length("text"))
    got = sorted((r["doc_id"] or 0, r["text"]) for r in lines.drop_repeats(shuffled).collect())
    want = []
    for i in (None, 5):
        x = f" of {i}"
        kept = longer.replace(" its", f" its{x}").split("\n")
        kept = [y for n, y in enumerate(kept) if n not in (2, 4) and not (i and n in (0, 3, 5))]
        want += [(i or 0, "" if i else line), (i or 0, "short and unique" + x), (i or 0, "\n".join(kept)), (i or 0, f"first{x}\nsecond{x}\n{x} third, alone")]
    assert got == sorted(want)
    judged = lines.judge(docs)
    assert judged.columns == ["doc_id", "line_no", "kept", "keeper_doc_id", "keeper_line_no", "distance"]
    assert judged.count() == sum(len(t.split("\n")) for _, t in rows)


def thue_morse(n, one, other):
    """A text whose polynomial sums modulo a power of two equal those of its complement."""
    return "".join(one if bin(i).count("1") % 2 else other for i in range(n))


def test_texts_made_to_collide(spark):
    """Two texts of 2,048 letters that are equal to any polynomial hash modulo 2**64 are neither equal lines nor near copies."""
    a, b = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    docs = spark.createDataFrame([(1, a), (2, b), (3, " ".join(a)), (4, " ".join(b)), (5, "x" + a), (6, "x" + b)], DOCS)
    got = {r["doc_id"]: r["keeper_doc_id"] for r in lines.judge(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 2}
    words = [(1, a + " and more"), (2, b + " and more"), (3, f"{a} {b}"), (4, f"{b} {a}")]
    check_groups(spark, words, 2)


def test_polynomials_by_brute_force():
    rng = np.random.default_rng(8)
    a, b = (rng.integers(0, lines.PRIME, 500, dtype=np.uint64) for _ in range(2))
    a[:3], b[:3] = lines.PRIME - 1, [lines.PRIME - 1, 0, 1]
    assert lines._times(a, b).tolist() == [int(x) * int(y) % lines.PRIME for x, y in zip(a, b, strict=True)]
    text, base = "the quick brown fox é\U0001f642", 987654321987654321 % lines.PRIME
    plain = lambda s: sum((ord(c) + 1) * pow(base, i, lines.PRIME) for i, c in enumerate(s)) % lines.PRIME
    h = lines._Hasher(np.array([ord(c) for c in "some" + text], np.uint32), base)
    begin, end = np.array([4]), np.array([4 + len(text)])
    assert h.whole(begin, end).tolist() == [plain(text)]
    assert [int(h.without(begin, np.array([4 + i]), end)[0]) for i in range(len(text))] == [plain(text[:i] + text[i + 1 :]) for i in range(len(text))]


# neighbours

VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[100:400] = x[50]  # many equal vectors
    x[500] *= 9
    got = ann.nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)).toPandas()
    y = x.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 20):
        scores = (y * y[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.array_equal(own.score.to_numpy(), scores[own.vec_id])
        assert own.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == own.vec_id.tolist()
        hits += len(set(own.vec_id) & set(order))
        if 100 <= q < 400:
            assert own.vec_id.tolist() == order
    assert hits / (75 * 20) >= 0.9


def test_vectors_of_odd_tables(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0], 1), (8, [-1.0, 0.5], None), (None, [1.0, 1.0], 1), (1, [0.5, 0.0], 1), (20, [1.0, 0.0], 2)]
    vectors = spark.createDataFrame(rows, VECTORS)
    wide = vectors.select("*", *[F.lit(1).alias(c) for c in ("block", "part", "list", "rank", "score", "query_id")])
    got = [tuple(r) for r in ann.nearest(wide).orderBy("query_id", "rank").collect()]
    # A shorter vector counts as having zeros behind its end.
    assert got == [(0, 1, 7, 1.0), (0, 2, 20, 1.0), (0, 3, 1, 0.5), (0, 4, 8, -1.0), (20, 1, 0, 1.0), (20, 2, 7, 1.0), (20, 3, 1, 0.5), (20, 4, 8, -1.0)]
    assert ann.nearest(vectors.limit(0)).count() == 0
    assert ann.nearest(vectors.where("vec_id = 0")).count() == 0


def test_overflowing_scores(spark):
    """Scores beyond double precision are infinite, and no number where two of them cancel; that one is the last."""
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1.0]), (2, [1e200, -1e200]), (3, [2.0, 1.0]), (4, [-1e200, 0.0])]
    got = [(r["vec_id"], str(r["score"])) for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(1, "inf"), (3, "3e+200"), (4, "-inf"), (2, "nan")]


def test_one_very_long_vector_beside_short_ones(spark, rng):
    """Blocks take a matrix of the usual length; what few vectors have beyond counts in scores all the same."""
    values = np.random.default_rng(8)
    rows = [(i, values.normal(size=6).tolist()) for i in range(300)]
    for i in (40, 77, 80):
        rows[i] = (i, values.normal(size=200_000 + i).tolist())
    x = np.zeros((300, 200_080))
    for i, v in rows:
        x[i, : len(v)] = v
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=5).toPandas()
    hits = 0
    for q in range(0, 300, 20):
        scores = x @ x[q]
        own = got[got.query_id == q].sort_values("rank")
        assert len(own) == 5 and np.allclose(own.score, scores[own.vec_id], rtol=1e-9)
        want = [i for i in np.argsort(-scores, kind="stable") if i != q][:5]
        hits += len(set(own.vec_id) & set(want))
        if q in (40, 80):
            assert set(want[:2]) & {40, 77, 80} <= set(own.vec_id)
    assert hits >= 0.9 * 75


def test_members_that_share_most_of_what_is_not_their_centres(spark, rng):
    """Pages of one template: each keeps 210 of 300 words and has 90 others, the same in all; a few pairs are linked."""
    words, others = [f"v{i}" for i in range(300)], [f"o{i}" for i in range(90)]
    rows = [(0, " ".join(words))]
    for i in range(1, 121):
        kept = sorted(rng.sample(range(300), 210))
        rows.append((i, " ".join([words[j] for j in kept] + others)))
    for i in range(1, 121, 24):
        rows.append((1000 + i, edited(rng, rows[i][1].split(), 4)))
    check_groups(spark, rows, 2)


def test_hot_keys_are_met_by_a_broadcast(spark, rng, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 2)
    monkeypatch.setattr(skew, "SHARE", 20)
    monkeypatch.setattr(near_dup, "DIFFERENCE_SALT", 3)
    test_many_members_apart_from_their_centre(spark, rng)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words)) for i in range(40)] + [(100 + i, edited(rng, words, 2)) for i in range(20)] + [(200 + i, f"alone {i}") for i in range(20)]
    check_groups(spark, rows, 2)
    assert near_dup.keep_first(spark.createDataFrame(rows, DOCS)).count() == len(set(brute(rows, 5).values()))
