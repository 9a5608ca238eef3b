"""Whitening by tiles, against numpy and exact whole numbers."""

import math

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>"


def brute(rows, components=32):
    """{(place of row, component): values} by exact sums and one covariance."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v)) for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[n * c - s for c, s in zip(r, sums, strict=True)] for r in x], float) / n
    cov = centred.T @ centred / n
    values, own = np.linalg.eigh(cov)
    values, own = values[::-1][:components], own[:, ::-1][:, :components]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    return kept, n, deviation, centred @ own, values, np.trace(cov)


def check(spark, rows, parts=3):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    kept, n, deviation, projected, values, trace = brute(rows)
    width = min(32, len(values))
    assert len(got) == len(kept) * width
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for (i, _), d, p in zip(kept, deviation, projected, strict=True):
        for c in range(width):
            same = by[i, c + 1]
            assert all(r["n"] == n for r in same) and d in {r["deviation"] for r in same}
            assert all(abs(r["explained"] - values[c] / trace) <= 1e-9 for r in same)
            if values[c] > 1e-9 * values[0]:
                assert any(abs(abs(r["whitened"]) - abs(p[c]) / math.sqrt(values[c])) < 1e-6 for r in same)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6
    return got


@pytest.mark.parametrize("dims", [1, 5, 70])
def test_whitening_by_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(400, dims)) @ rng.normal(size=(dims, dims)) * 0.3 + rng.normal(size=dims)
    got = check(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    whitened = np.zeros((400, min(dims, 32)))
    for r in got:
        whitened[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(whitened.T, bias=True) - np.eye(min(dims, 32))).max() < 1e-6


def test_tiles_and_row_blocks_of_any_size(spark, monkeypatch):
    """Many small row blocks, tiles and partitions give what one gives."""
    monkeypatch.setattr(whitening, "ENTRIES", 200)
    monkeypatch.setattr(whitening, "PARTITION_BYTES", 500)
    monkeypatch.setattr(whitening, "SIDE", 4)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 13)) @ rng.normal(size=(13, 13))
    check(spark, [(i, v.tolist()) for i, v in enumerate(x)])


def test_whitening_of_odd_tables(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    odd = [(None, [1.0, 2.0, 3.0, 4.0]), (41, None), (42, [1.0, None, 2.0, 3.0]), (43, [math.nan, 1.0, 1.0, 1.0]), (44, [1.0, math.inf, 1.0, 1.0]), (45, [0.0] * 4), (46, [2.5, -1.0]), (47, [])]
    check(spark, rows + odd + rows[:3] + [rows[0]] * 5)
    for none in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(none, SCHEMA)).collect() == []
    equal = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)).collect()
    assert len(equal) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in equal)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and flat[0]["identity_error"] < 1e-9
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as component", "'x' as whitened", "3 as place")
    assert whitening.whiten(wide).count() == 160


def test_huge_entries(spark):
    """Entries that no long holds end at its bounds; a deviation beyond a long is null, one near its end exact."""
    got = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, 2.0])], SCHEMA)).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got if r["vec_id"] != 3)
    near = [(1, [47453132.8]), (2, [0.0])]
    x = [math.floor(64 * v[0]) + 1_000_000 for _, v in near]
    for r in whitening.whiten(spark.createDataFrame(near, SCHEMA)).collect():
        want = (2 * x[r["vec_id"] - 1] - sum(x)) ** 2
        assert r["deviation"] == (want if want < 1 << 63 else None)
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(spark.createDataFrame([(1, [1.0] * (whitening.MAX_DIMS + 1))], SCHEMA))
