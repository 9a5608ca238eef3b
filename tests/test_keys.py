"""Ids and paths that are claimed twice, in tables, streams and sequences; and what they rest on."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_runner import read, sequence

from tidemark.functions import columns as C
from tidemark.operators import order, scope
from tidemark.operators.registry import IntegrityError
from tidemark.plans import catalog
from tidemark.plans.runner import SequenceRunner
from tidemark.streaming import arrivals, keys


def test_full_case_folding_of_every_character(spark):
    points = spark.range(1, 0x110000).where("id < 55296 or id > 57343")
    chars = points.selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') as c")
    rows = chars.select("c", C.casefold(F.concat(F.lit("A"), "c", F.lit("Z"))).alias("f")).toArrow()
    assert len(rows) == 0x110000 - 1 - 2048
    assert all(f == f"A{c}Z".casefold() for c, f in zip(rows["c"].to_pylist(), rows["f"].to_pylist(), strict=True))
    few = spark.createDataFrame([("STRASSE",), ("Straße",), ("ΣΑΣ σας",), ("İi̇",), (None,), ("",)], "x string").select(C.owner_key(F.col("x")).alias("k"))
    assert [r["k"] for r in few.collect()] == ["strasse", "strasse", "σασ σασ", "i̇i̇", None, ""]


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_running_sums(spark, monkeypatch, stretch):
    monkeypatch.setattr(order, "STRETCH", stretch)
    rows = [(i * i - 20, i % 5) for i in range(30)]
    got = {r["i"]: r["s"] for r in order.running_sum(spark.createDataFrame(rows, "i int, n int"), "i", "n", "s").collect()}
    assert got == {i: sum(n for j, n in rows if j <= i) for i, _ in rows}


def test_scope_counts_do_not_deal_groups_to_tasks(spark):
    sizes = spark.createDataFrame([("a", 3), ("b", 2), ("c", 5)], "group string, n bigint")
    groups = spark.createDataFrame([("a", 0), ("b", 4), ("c", 4), ("none", 9)], "group string, idx int")
    found = scope.counts_of(sizes, groups)
    assert sorted(map(tuple, found.collect())) == [(0, 3, 3, 0), (4, 10, 7, 3), (9, 10, 0, 10)]
    assert sorted(map(tuple, scope.counts_of(sizes, groups, "current").collect())) == [(0, 3, 3, 0), (4, 7, 7, 0), (9, 0, 0, 0)]
    assert "Generate" not in found._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="unknown rule"):
        scope.counts_of(sizes, groups, "none")


def batches(n, rng):
    names = [f"s{i}" for i in range(40)]
    paths = ["/d/images/A.jpg", "/d/images/a.JPG", "/d/images/straße.jpg", "/d/images/STRASSE.jpg", *[f"/d/images/{i}.jpg" for i in range(60)]]
    return [[(rng.choice(names), f"g{b}", "train", b, rng.choice([*paths, None])) for _ in range(rng.choice([1, 8]))] for b in range(n)]


def brute(found):
    """Samples taken by batch, and {(kind, key): (n, first id)} of clashes."""
    seen, first, taken = Counter(), {}, []
    for rows in found:
        own = [[(kind, key) for kind, key in (("id", r[0]), ("owner", r[4] and r[4].casefold())) if key is not None] for r in rows]
        seen.update(k for ks in own for k in ks)
        for r, ks in zip(rows, own, strict=True):
            for k in ks:
                first[k] = min(first.get(k, (r[3], r[0])), (r[3], r[0]))
        taken.append(sorted(r[0] for r, ks in zip(rows, own, strict=True) if len(ks) == 2 and all(seen[k] == 1 for k in ks)))
    return taken, {(*k, n, first[k][1]) for k, n in seen.items() if n > 1}


def test_folding_goes_through_a_text_a_few_times(spark):
    """Not once for each character that becomes several; texts may hold many of them, and none."""
    assert str(C.casefold(F.col("c"))).count("replace(") <= 2
    texts = ["", "Straße ŉ ﬃ " * 500, "".join(C.folding()[2]) * 3, "É" * 40, "plain ASCII", "ẞß\U0001e900İ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select("c", C.casefold(F.col("c")).alias("f")).collect()
    assert [r["f"] for r in rows] == [t and t.casefold() for t in texts]


def test_stream_queries_take_all_groups_in_many_files(spark, tmp_path, monkeypatch):
    """Batches of several files each, a batch without samples, and groups beyond the twentieth."""
    sources = [*range(10), *range(15, 23)]
    rows = [(i, f"Wörter {i % 550} STRASSE" if i % 3 else f"wörter {i % 550} straße", "de", f"src{sources[i % len(sources)]}", i // 20) for i in range(600)]
    table = str(tmp_path / "data" / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4, "doc_id").write.parquet(table)
    monkeypatch.setattr(catalog, "new_place", lambda spark, name: str(tmp_path / name))
    got = {"stream_accepted": catalog.stream_accepted(spark, str(tmp_path / "data")).collect()}
    landed = [len(list((tmp_path / "checked" / "rows" / f"batch={b}").glob("*.parquet"))) for b in (0, 1, 3, 4)]
    assert min(landed) > 1 and len(list((tmp_path / "checked" / "in").glob("*.parquet"))) > 5  # no batch in one task
    monkeypatch.setattr(catalog, "new_place", lambda spark, name: str(tmp_path / "again" / name))
    got["stream_clashes"] = catalog.stream_clashes(spark, str(tmp_path / "data")).select("kind", "k", "n", "first_id").collect()
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from read_parquet('{table}/*.parquet')")
        for name, found in got.items():
            assert sorted(map(tuple, found)) == sorted(con.execute(catalog.oracle_sql()[name]).fetchall()) and found
    assert {r["batch"] for r in got["stream_accepted"]} == {0, 1, 3, 4}


def test_checked_stream_also_after_a_replayed_batch(spark, tmp_path):
    own, rows = keys.session(spark), batches(4, random.Random(3))
    for part in rows:
        spark.createDataFrame(part, arrivals.CHECKED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told, failed = [], []

    def arrived(counts, number):
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("lost after all was written")

    def clash(found, number):
        told.append((number, found.count()))

    def follow():
        source = arrivals.source(own, str(tmp_path / "in"), schema=arrivals.CHECKED)
        arrivals.follow_checked(source, str(tmp_path / "reg"), str(tmp_path / "cp"), arrived, clash).awaitTermination()

    with pytest.raises(Exception, match="lost after"):
        follow()
    follow()
    taken, clashes = brute(rows)
    kept = spark.read.schema(arrivals.CHECKED + ", batch int").parquet(str(tmp_path / "reg")).collect()
    assert [sorted(r["sample_id"] for r in kept if r["batch"] == b) for b in range(4)] == taken
    assert {tuple(r) for r in arrivals.clash_table(spark, str(tmp_path / "reg")).collect()} == clashes
    whole = keys.clashes(keys.claims(spark.createDataFrame([r for part in rows for r in part], arrivals.CHECKED), "idx"))
    assert {tuple(r) for r in whole.collect()} == clashes
    by_batch = dict(told)
    assert all(by_batch[b] == n for b, n in told)  # the batch that ran twice told the same twice


def test_watch_takes_only_what_is_new(spark, tmp_path):
    schema = "sample_id string, image_path string"
    watch = keys.Watch(spark, str(tmp_path / "x [1]"), spark.createDataFrame([], schema).schema, str(tmp_path / "keys"))

    def land(name, rows):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "x [1]" / name))
        watch.check()

    land("a", [("a::1", "/d/images/1.jpg"), ("a::2", "/d/images/2.jpg")])
    land("b", [(f"b::{i}", f"/e/images/{i}.jpg") for i in range(50)])
    land("c", [("c::1", "/f/images/Straße.jpg")])
    with pytest.raises(IntegrityError, match="more than one split: /f/images/strasse.jpg"):
        land("d", [("d::1", "/f/images/STRASSE.jpg")])


def test_work_of_a_check_is_that_of_the_new_part(spark, tmp_path):
    """One exchange, of what has just landed; rows read do not grow with what has landed before."""
    schema = "sample_id string, image_path string"
    watch = keys.Watch(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, str(tmp_path / "keys"))
    read_, plans = [], []
    for i in range(3):
        spark.createDataFrame([(f"{i}::{j}", f"/{i}/images/{j}.jpg") for j in range(40)], schema).write.parquet(str(tmp_path / "in" / str(i)))
        query = watch._query().option("checkpointLocation", str(tmp_path / "keys" / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        read_.append(query.lastProgress["numInputRows"])
        plans.append(query._jsq.explainInternal(False))
    assert read_ == [40, 40, 40]
    assert all(p.count("Exchange ") == 1 and p.count("StateStoreRestore") == 1 for p in plans)


def test_sequence_stops_at_a_path_that_an_earlier_group_owns(spark, tmp_path, dataset):
    first, second = dataset("s0"), dataset("s1")
    again = tmp_path / "data" / "s2.yaml"
    again.write_text(open(first).read())
    runner = SequenceRunner(spark, sequence(tmp_path, [first, second, str(again)]))
    with pytest.raises(IntegrityError, match="more than one split"):
        runner.run()
    status = read(runner.run_.folder, "sequence_status.json")
    assert (status["status"], status["completed_tasks"], status["error_type"]) == ("failed", 2, "IntegrityError")
