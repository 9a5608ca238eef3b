import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import backends, cli, doctor
from tidemark.operators.registry import IntegrityError
from tidemark.plans.runner import SequenceRunner, TaskRunner, devices, file_name, first_weights
from tidemark.sources import files, images, shared
from tidemark.streaming import arrivals


def read(path, *parts):
    return json.loads(Path(path, *parts).read_text())


def lines(path):
    """The lines of a folder of text parts, in the order of the parts."""
    return [line for part in sorted(Path(path).glob("part-*")) for line in part.read_text().splitlines()]


def test_group_records(spark, dataset):
    records, spec = images.group(spark, "g", dataset("g"))
    rows = sorted(map(tuple, records.collect()))
    assert rows[0][0] == "g::images/test/g_test_0.jpg" and len(rows) == 4
    assert rows[0][2].endswith("/labels/test/g_test_0.txt") and spec.names == ("object",)


def test_manifest_entries(spark, tmp_path, dataset):
    path = dataset("g")
    listing = tmp_path / "data" / "g" / "list.txt"
    listing.write_text("  images/train/g_train_0.jpg \n\n./images/../images/train/absent.xyz\nimages/train/g_train_0.jpg\n")
    Path(path).write_text(f"path: {tmp_path}/data/g\ntrain: [list.txt, images/train/g_train_1.jpg]\nval: images/val\ntest: images/test\nnames: [object]\n")
    records, _ = images.group(spark, "g", path)
    found = sorted(r["sample_id"] for r in records.where("split = 'train'").collect())
    assert found == ["g::images/train/absent.xyz", "g::images/train/g_train_0.jpg", "g::images/train/g_train_1.jpg"]


def test_odd_names_are_listed(spark, tmp_path):
    """Hidden, empty and pattern-like names are files like any other."""
    root = tmp_path / "run [1]{a}"
    names = ["images/train/_e.jpg", "images/train/.g.JPG", "images/train/zero.png", "images/train/a, b*.jpg", "images/_more/x.jpg", "images/val/v.jpg", "images/test/t.jpg"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if "zero" in name else b"x")
    (root / "_list.txt").write_text("images/test/t.jpg\n")
    (root / "x[1].txt").write_text("images/val/v.jpg\n")
    (root / "_d[1].yaml").write_text("train: [images/train, images/_more]\nval: 'x[1].txt'\ntest: _list.txt\nnames: [object]\n")
    records, spec = images.group(spark, "g", str(root / "_d[1].yaml"))
    assert sorted(r["sample_id"] for r in records.collect()) == sorted(f"g::{n}" for n in names) and spec.names == ("object",)


def test_dataset_faults(spark, tmp_path, dataset):
    path = dataset("g", counts=(("train", 1), ("val", 1), ("test", 0)))
    with pytest.raises(IntegrityError, match="no images"):
        images.group(spark, "g", path)
    (tmp_path / "bad.yaml").write_text("train: a\n")
    with pytest.raises(ValueError, match="lacks"):
        images.describe(spark, str(tmp_path / "bad.yaml"))
    with pytest.raises(FileNotFoundError):
        images.entry(spark, str(tmp_path), "nowhere")
    for bad in ({0: "a", 2: "b"}, "a", [1]):
        with pytest.raises(ValueError):
            images.class_names(bad)
    with pytest.raises(IntegrityError, match="label schema mismatch"):
        images.registry(spark, {"h": dataset("h"), "i": dataset("i", "{0: other}")})


def test_task(spark, dataset, task_config):
    config = task_config({"s0": dataset("s0"), "s1": dataset("s1")})
    out = TaskRunner(spark, config).run()
    assert Path(out).name == "t__unit__s1__net__s3"
    result = read(out, "task_result.json")
    assert result["status"] == read(out, "task_status.json")["status"] == "completed"
    assert result["cost"]["candidate_count"] == result["cost"]["selected_count"] == 4
    assert result["cost"]["optimizer_steps"] == 4 and result["cost"]["images_read"] == 8
    assert result["cost"]["training_seconds"] == pytest.approx(0.008) and result["cost"]["evaluation_seconds"] == pytest.approx(0.004)
    assert result["metrics"]["best"]["s1"]["map50_95"] == pytest.approx(1 / 4)
    assert result["artifacts"]["last_checkpoint"] == "checkpoints/last.pt"
    manifest = lines(Path(out, "data", "backend_train_images.txt"))
    assert manifest == sorted(manifest) and len(manifest) == 4 and not list(Path(out).rglob("*.jpg"))
    with pytest.raises(FileExistsError):
        TaskRunner(spark, config).run()


class Failing(backends.Stub):
    """Fails in the n-th training."""

    def __init__(self, spark, at):
        super().__init__(spark)
        self.at, self.count = at, 0

    def train(self, request):
        self.count += 1
        if self.count == self.at:
            raise RuntimeError("no more memory")
        return super().train(request)


def test_failing_task_leaves_no_result(spark, dataset, task_config):
    runner = TaskRunner(spark, task_config({"s0": dataset("s0")}), Failing(spark, 1))
    with pytest.raises(RuntimeError):
        runner.run()
    out = Path(runner.run_.folder)
    assert read(out, "task_status.json")["error_type"] == "RuntimeError"
    assert "no more memory" in (out / "logs" / "error.txt").read_text() and not (out / "task_result.json").exists()


def sequence(tmp_path, paths, candidate="all_seen", policy=None, source="parent"):
    return {
        "sequence": {"name": "q", "label": "l", "seed": 5, "output_root": str(tmp_path / "seq")},
        "arrivals": [{"id": Path(p).stem, "data": p} for p in paths],
        "scope_rule": {"candidate": candidate, "evaluation": "seen"},
        "initialization": {"first": {"source": "pretrained", "checkpoint": "w.pt"}, "subsequent": {"source": source, "checkpoint": "last"}},
        "task_template": {"model": {"backend": "stub", "definition": "n.yaml"}, "budget": {"value": 1}, "select_policy": policy or {"name": "full"}},
    }


def test_sequence(spark, tmp_path, dataset):
    out = SequenceRunner(spark, sequence(tmp_path, [dataset(f"s{i}") for i in range(3)])).run()
    found = read(out, "sequence_result.json")["summary"]
    assert [sorted(r) for r in found["matrix"]] == [["s0"], ["s0", "s1"], ["s0", "s1", "s2"]]
    assert found["seen_mean"] == pytest.approx([1 / 17] * 3) and found["final_forgetting"] == {"s0": 0, "s1": 0, "s2": 0}
    tasks = sorted(Path(out, "tasks").iterdir())
    assert [t.name for t in tasks] == ["000__s0__l", "001__s1__l", "002__s2__l"]
    assert read(tasks[2], "task_result.json")["parent_result"] == str(tasks[1])
    assert Path(out, "summary", "metrics_by_task.csv").read_text().splitlines()[0] == "task,task_label,s0.map50_95,seen_mean,s1.map50_95,s2.map50_95"


def test_sequence_stops_at_the_first_failure(spark, tmp_path, dataset):
    runner = SequenceRunner(spark, sequence(tmp_path, [dataset(f"s{i}") for i in range(3)]), Failing(spark, 2))
    with pytest.raises(RuntimeError):
        runner.run()
    out = Path(runner.run_.folder)
    status = read(out, "sequence_status.json")
    assert (status["status"], status["completed_tasks"]) == ("failed", 1) and len(list((out / "tasks").iterdir())) == 2


@pytest.mark.parametrize(
    ("candidate", "policy", "source", "expected"),
    [("all_seen", None, "pretrained", (4, 4)), ("all_seen", None, "parent", (4, 4)), ("current", None, "parent", (2, 2)), ("all_seen", {"name": "random_replay", "params": {"replay_size": 1}}, "parent", (4, 3))],
)
def test_baselines(spark, tmp_path, dataset, candidate, policy, source, expected):
    out = SequenceRunner(spark, sequence(tmp_path, [dataset("s0"), dataset("s1")], candidate, policy, source)).run()
    spent = read(sorted(Path(out, "tasks").iterdir())[1], "metrics", "cost.json")
    assert (spent["candidate_count"], spent["selected_count"]) == expected


def test_initialization_faults(spark, tmp_path, task_config, dataset):
    catalog = {"s0": dataset("s0")}
    for start, error in (({"source": "explicit", "checkpoint": str(tmp_path / "no.pt")}, FileNotFoundError), ({"source": "pretrained"}, ValueError), ({"source": "parent", "checkpoint": "last"}, FileNotFoundError)):
        config = task_config(catalog, initialization=start)
        config["task"]["parent_result"] = str(tmp_path / "none")
        with pytest.raises(error):
            first_weights(spark, config, ("object",))
    parent = tmp_path / "parent"
    parent.mkdir()
    config = task_config(catalog, initialization={"source": "parent", "checkpoint": "best"})
    config["task"]["parent_result"] = str(parent)
    for result, match in (({"status": "failed"}, "not completed"), ({"status": "completed", "label_schema": ["x"]}, "label schema"), ({"status": "completed", "label_schema": ["object"], "artifacts": {"best_checkpoint": "b.pt"}}, "no checkpoint")):
        (parent / "task_result.json").write_text(json.dumps(result))
        with pytest.raises((ValueError, FileNotFoundError), match=match):
            first_weights(spark, config, ("object",))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    conf = N(get=lambda *a: None)
    session = N(conf=conf, sparkContext=N(master="yarn", applicationId="x", getConf=lambda: conf))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_root(session)
    named = N(get=lambda key, default=None: "hdfs://x/y/")
    assert shared.new_place(N(conf=named), "t").startswith("hdfs://x/y/t-")


def test_files(spark, tmp_path):
    files.put_csv(spark, str(tmp_path / "a.csv"), [{"task": 0, "current": 2}, {"task": 1, "current": 2, "replay": 1}])
    assert (tmp_path / "a.csv").read_text().split() == ["task,current,replay", "0,2,", "1,2,1"]
    files.put_csv(spark, str(tmp_path / "b.csv"), [])
    assert (tmp_path / "b.csv").read_text() == ""
    (tmp_path / "h.csv").write_text(" epoch , loss,note\n1, 2.5 ,x\n2,1e-1,\n")
    history = files.get_history(spark, str(tmp_path / "h.csv"))
    assert history.dtypes == [("epoch", "double"), ("loss", "double"), ("note", "string")]
    assert files.get_history(spark, str(tmp_path / "none.csv")) is None
    files.put_lines(spark.range(100).withColumn("v", F.concat(F.lit("x"), "id")), str(tmp_path / "l"), "id", "v")
    assert lines(tmp_path / "l") == [f"x{i}" for i in range(100)]
    with pytest.raises(ValueError):
        files.put_text(spark, str(tmp_path / "j.json"), "[1]")
        files.get_json(spark, str(tmp_path / "j.json"))
    with pytest.raises(TypeError):
        files.put_json(spark, str(tmp_path / "k.json"), {"a": object()})


def test_backend_boundary(spark, task_config):
    config = task_config({"a": "a"})
    given = backends.training_arguments(config, "d.yaml", "/o")
    assert (given["epochs"], given["seed"], given["batch"], given["deterministic"], given["exist_ok"]) == (2, 3, 3, True, False)
    config["backend"]["params"]["odd"] = 1
    with pytest.raises(ValueError, match="odd"):
        backends.training_arguments(config, "d", "/o")
    with pytest.raises(ValueError, match="unknown backend"):
        backends.backend(spark, {"model": {"backend": "x"}})
    assert backends.optimizer_steps(5, 0, 2) == 10
    assert [devices({"backend": {"params": {"device": d}}}) for d in ("cpu", "0", ["0", "1"], "CPU")] == [0, 1, 2, 0]
    assert file_name("a/b  c") == "a-b-c" and file_name("--.") == "run"


class Box:
    map, map50, mp, mr, maps = 0.4, 0.5, 0.6, 0.7, [0.4]


def test_library_backend(spark, tmp_path, dataset, task_config, monkeypatch):
    """The library as it is called: manifests, arguments, copies of checkpoints, scores, predictions by id."""
    import sys
    import types

    calls = []

    class Model:
        def __init__(self, checkpoint):
            self.checkpoint = checkpoint

        def train(self, **given):
            weights = Path(given["project"], given["name"], "weights")
            weights.mkdir(parents=True)
            (weights / "last.pt").write_text("w")
            (weights.parent / "results.csv").write_text("epoch, loss\n1, 2.5\n")
            calls.append((self.checkpoint, Path(given["data"]).read_text()))

        def val(self, **given):
            return types.SimpleNamespace(box=Box)

        def predict(self, source, **_):
            return [f"seen {Path(p).name}" for p in source]

    monkeypatch.setitem(sys.modules, "ultralytics", types.SimpleNamespace(YOLO=Model))
    config = task_config({"s0": dataset("s0")}, model={"backend": "ultralytics", "definition": "net.yaml"})
    out = Path(TaskRunner(spark, config).run())
    result = read(out, "task_result.json")
    assert result["artifacts"]["data_yaml"] == "data/backend_data.yaml" and calls[0][0] == "net.pt"
    assert (out / "checkpoints" / "best.pt").read_text() == (out / "checkpoints" / "last.pt").read_text() == "w"
    assert result["metrics"]["last"]["s0"]["map50_95"] == 0.4 and result["metrics"]["best"]["s0"]["per_class_ap"] == {"object": 0.4}
    assert (out / "metrics" / "train_history.csv").read_text().split() == ["epoch,loss", "1.0,2.5"]
    listed = (out / "data" / "backend_train_images.txt").read_text().split()
    assert len(listed) == 2 and listed == sorted(listed)
    rows = spark.createDataFrame([(1, "b", "/x/2.jpg"), (0, "a", "/x/1.jpg")], "pos int, sample_id string, image_path string")
    own = backends.backend(spark, config)
    assert own.predict(rows, "w.pt") == {"a": "seen 1.jpg", "b": "seen 2.jpg"} and own.predict(rows.limit(0), "w.pt") == {}
    (out / "checkpoints" / "best.pt").unlink()
    with pytest.raises(FileNotFoundError, match="no checkpoint"):
        first_weights(spark, config | {"task": {"parent_result": str(out)}, "initialization": {"source": "parent", "checkpoint": "best"}}, ("object",))
    with pytest.raises(FileNotFoundError):  # a folder is no checkpoint
        first_weights(spark, config | {"initialization": {"source": "explicit", "checkpoint": str(out)}}, ("object",))


def test_command_line(tmp_path, spark, capsys):
    assert cli.main(["task", "--config", str(tmp_path / "none.yaml")]) == 1
    assert "tidemark:" in capsys.readouterr().err
    assert doctor.sound(doctor.report()) and cli.main(["doctor"]) == 0
    root = Path(doctor.__file__).parents[1]
    assert cli.main(["doctor", "--project-root", str(root)]) == 0 and cli.main(["doctor", "--project-root", str(tmp_path)]) == 1
    pinned = doctor.report(training=True)
    assert pinned["torch_ok"] == (pinned["torch"] or "").startswith("2.6.0") and "gpus" in pinned and not doctor.sound(pinned | {"torch_ok": False})


def test_arrival_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(3):
        rows = [(f"g{i}::{j}", f"g{i}", "train", i) for j in range(2)]
        spark.createDataFrame(rows, arrivals.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    seen = []
    query = arrivals.follow(arrivals.source(spark, folder), str(tmp_path / "reg"), str(tmp_path / "cp"), lambda df, n: seen.append({r["task"]: r["candidate_count"] for r in df.collect()}))
    query.awaitTermination()
    assert len(seen) == 3 and seen[-1] == {0: 2, 1: 4, 2: 6}
    counts = arrivals.counts(arrivals.source(spark, folder, 10)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert {(r["group"], r["n"]) for r in spark.table("counts").collect()} == {(f"g{i}", 2) for i in range(3)}
