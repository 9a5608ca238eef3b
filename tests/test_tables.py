"""What used to pass through the driver, as tables: evaluations, predictions, replays, members, ragged rows, faults."""

import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark import backends
from tidemark.functions import columns as C
from tidemark.operators import registry, scope, selection
from tidemark.operators.order import places
from tidemark.sources import files


def images_of(spark, sizes):
    rows = [(g, f"{g}{i}", f"{g}{i}", f"/d/{g}/{i}.jpg") for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "group string, pos string, sample_id string, image_path string")


def test_a_grid_of_evaluations_is_one_plan(spark, tmp_path):
    """The stub's plan gives what its evaluations give one by one, also for a group without tests."""
    stub = backends.Stub(spark)
    asked = backends.GridRequest({"backend": {"params": {"batch": 3}}}, images_of(spark, {"a": 2, "b": 5}), ("b", "a", "none"), ("x", "y"), {"last": "l.pt", "best": "b.pt"}, str(tmp_path))
    grid = stub.evaluate_grid(asked)
    by_key = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: (r["checkpoint"], r["group"]))
    loop = backends.Backend.evaluate_grid(stub, asked)
    assert by_key(grid) == by_key(loop) and len(by_key(grid)) == 6
    assert [(c.name, c.dataType) for c in grid.schema] == [(c.name, c.dataType) for c in loop.schema]
    counted = grid._jdf.queryExecution().optimizedPlan().toString()
    assert counted.count("image_path") <= 1 and counted.count("count(1)") == 1


def test_predictions_come_from_tasks_in_the_order_of_their_places(spark):
    """A model per task, batches of any size, answers beside the ids that were asked."""
    ids = spark.range(1000).select(F.format_string("s%03d", (F.col("id") * 7919) % 1000).alias("sample_id"))
    asked = places(ids, "sample_id").select(F.col("_place").alias("pos"), "sample_id", F.concat(F.lit("/d/"), "sample_id", F.lit(".jpg")).alias("image_path")).repartition(6)

    class Answer:
        def __init__(self, path, number):
            self.path, self.number = path, number

        def to_json(self):
            return f"{self.path} {self.number}"

    def load():
        seen = []

        def model(paths):
            seen.extend(paths)
            return (Answer(p, len(seen) - len(paths) + i) for i, p in enumerate(paths))

        return model

    got = backends.predicted(asked, load, 16).orderBy("pos").collect()
    assert [(r["pos"], r["sample_id"]) for r in got] == [(i, f"s{i:03d}") for i in range(1000)]
    assert all(r["prediction"].split()[0] == f"/d/{r['sample_id']}.jpg" for r in got)
    numbers = sorted(int(r["prediction"].split()[1]) for r in got)
    assert numbers[-1] < 999 and numbers.count(0) == 6  # six tasks, six models
    assert backends.predicted(asked.limit(0), load).collect() == []
    with pytest.raises(PySparkException, match="16 images have 15 predictions"):
        backends.predicted(asked, lambda: lambda paths: paths[1:], 16).collect()


@pytest.mark.parametrize("margin", [1.0, 0.02, 0.0])
def test_replays_of_all_tasks_are_exact_whatever_the_bound_lets_pass(spark, monkeypatch, margin):
    """Groups of unequal size, one empty: the rows of the plain way, also where a bound leaves too few."""
    monkeypatch.setattr(selection, "MARGIN", margin)
    sizes = {"a": 400, "b": 3, "c": 0, "d": 900, "e": 40}
    rows = [(g, f"{g}{i}") for g, n in sizes.items() for i in range(n)]
    samples = spark.createDataFrame(rows, "group string, sample_id string")
    order = spark.createDataFrame([(g, i * 2) for i, g in enumerate(sizes)], "group string, idx int")
    history = samples.join(scope.sees(order, "all_seen").where("not is_current"), "group").select("task", "sample_id")
    want = sorted(map(tuple, selection.sample_per_task(history, 20, 7).select("task", "sample_id").collect()))
    assert sorted(map(tuple, selection.replay_per_task(samples, order, 20, 7).collect())) == want
    assert len(want) == 4 * 20


def test_a_bound_lets_few_keys_leave_their_group(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(selection, "new_place", lambda spark, name: written.append(str(tmp_path / name)) or written[0])
    samples = spark.range(40_000).select(F.format_string("g%d", F.col("id") % 4).alias("group"), F.col("id").cast("string").alias("sample_id"))
    order = spark.createDataFrame([(f"g{i}", i) for i in range(4)], "group string, idx int")
    assert selection.replay_per_task(samples, order, 10, 1).count() == 30
    assert spark.read.parquet(written[0]).count() < 3 * 120  # of 60,000 pairs of a sample and a task


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_chunks_of_members(spark, size):
    rows = [(g, s, f"{g}::{s}{i:02d}") for g, s, n in (("a", "train", 9), ("a", "val", 1), ("b", "train", 4)) for i in range(n)]
    got = registry.member_chunks(spark.createDataFrame(rows[::-1], "group string, split string, sample_id string"), size).orderBy("group", "split", "chunk").collect()
    for key in {(r["group"], r["split"]) for r in got}:
        own = [r for r in got if (r["group"], r["split"]) == key]
        assert [i for r in own for i in r["ids"]] == sorted(i for g, s, i in rows if (g, s) == key)
        assert [r["first"] for r in own] == [size * i for i in range(len(own))] and all(len(r["ids"]) <= size for r in own)
        assert all(r["digest"] == hashlib.sha256("\n".join(r["ids"]).encode()).hexdigest() for r in own)


def test_ragged_rows_of_any_number(spark, tmp_path):
    rows = [(i, {"x": str(i), **({"late": "q,\"1\""} if i == 700 else {}), **({"odd": "o"} if i % 2 else {})}) for i in range(1000)]
    table = spark.createDataFrame(rows, "n int, cells map<string, string>").repartition(5)
    assert files.put_ragged(table, str(tmp_path / "r"), "n") == ["x", "odd", "late"]
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "r"))
    assert back.columns == ["x", "odd", "late"] and back.count() == 1000
    assert {r["x"]: (r["odd"], r["late"]) for r in back.where("late is not null or x = '3'").collect()}["3"] == ("o", None)
    assert back.where("odd is not null").count() == 500 and back.where("late is not null").count() == 1
    firsts = [p.read_text().splitlines()[0] for p in sorted((tmp_path / "r").glob("part-*"))]
    assert set(firsts) == {"x,odd,late"}


def test_faults_are_what_records_fail_for(spark):
    paths = {"a": "/d/images/x.jpg", "b": "/e/images/x.jpg", "c": "/d/pics/x.jpg", "d": None, "e": "/d/Images/y"}
    rows = spark.createDataFrame(list(paths.items()), "sample_id string, image_path string")
    assert {tuple(r) for r in registry.path_faults(rows, "/d").collect()} == {("b", "not below the dataset root"), ("c", "no images directory"), ("d", "no path")}
    for bad, match in (("b", "not below"), ("c", "no images directory")):
        one = rows.where(F.col("sample_id") == bad).select(C.relative_path(F.col("image_path"), "/d"), C.label_path(F.col("image_path")))
        with pytest.raises(PySparkException, match=match):
            one.collect()
    held = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "test")], "group string, split string")
    groups = spark.createDataFrame([("a",), ("b",), ("c",)], "group string")
    lacking = {tuple(r) for r in registry.empty_splits(held, groups).collect()}
    assert lacking == {("a", "test"), ("b", "train"), ("b", "val"), ("c", "train"), ("c", "val"), ("c", "test")}
