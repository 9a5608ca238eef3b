import pytest

from tidemark import config as cfg


def test_overlay_goes_into_maps_of_any_depth_only():
    """Three layers: maps grow key by key, whatever else stands below a key gives way whole, and layers stay as they were."""
    layers = [
        {"model": {"head": {"width": 8, "heads": ("u", "v")}, "tail": "thin"}, "lr": 0.5},
        {"model": {"head": {"depth": 3}, "tail": {"kind": "wide"}}, "notes": []},
        {"model": {"head": {"heads": ("w",), "width": None}}, "lr": {"start": 1}},
    ]
    before = repr(layers)
    assert cfg.overlay(*layers) == {
        "model": {"head": {"width": None, "depth": 3, "heads": ("w",)}, "tail": {"kind": "wide"}},
        "lr": {"start": 1},
        "notes": [],
    }
    assert repr(layers) == before and cfg.overlay({}, layers[0]) == layers[0]


def test_includes_go_below_and_may_repeat(tmp_path):
    (tmp_path / "base.yaml").write_text("budget: {value: 1}\nmodel: {definition: a}\n")
    (tmp_path / "left.yaml").write_text("include: base.yaml\nbudget: {value: 2}\n")
    (tmp_path / "right.yaml").write_text("include: base.yaml\n")
    (tmp_path / "top.yaml").write_text("include: [left.yaml, right.yaml]\nmodel: {backend: stub}\n")
    assert cfg.read(tmp_path / "top.yaml") == {"budget": {"value": 1}, "model": {"definition": "a", "backend": "stub"}}


def test_include_cycle_names_the_chain(tmp_path):
    (tmp_path / "a.yaml").write_text("include: b.yaml\n")
    (tmp_path / "b.yaml").write_text("include: a.yaml\n")
    with pytest.raises(cfg.ConfigError, match="a.yaml.*b.yaml.*a.yaml"):
        cfg.read(tmp_path / "a.yaml")


def test_empty_file_and_wrong_root(tmp_path):
    (tmp_path / "a.yaml").write_text("")
    (tmp_path / "b.yaml").write_text("- 1\n")
    assert cfg.read(tmp_path / "a.yaml") == {}
    with pytest.raises(cfg.ConfigError, match="not a mapping"):
        cfg.read(tmp_path / "b.yaml")


def test_paths_are_relative_to_the_file_that_has_them(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "low.yaml").write_text("data: {catalog: {1: x.yaml}}\ninitialization: {source: explicit, checkpoint: w.pt}\n")
    (tmp_path / "top.yaml").write_text("include: sub/low.yaml\ntask: {output_root: out}\n")
    found = cfg.read(tmp_path / "top.yaml")
    assert found["data"]["catalog"] == {"1": str(tmp_path / "sub" / "x.yaml")}
    assert found["initialization"]["checkpoint"] == str(tmp_path / "sub" / "w.pt")
    assert found["task"]["output_root"] == str(tmp_path / "out")


def test_overrides():
    config = {"a": {"b": 1}, "c": 2}
    cfg.override(config, "a.d.e=[1, x]")
    assert config["a"]["d"]["e"] == [1, "x"]
    for bad in ("a", "a..b=1", "c.d=1", ".a=1", "a.=1", "=1"):
        with pytest.raises(cfg.ConfigError):
            cfg.override(config, bad)


@pytest.mark.parametrize(
    ("key", "value", "message"),
    [
        ("task.output_root", None, "output_root"),
        ("data.catalog", {}, "catalog"),
        ("data.current", [], "data.current"),
        ("data.test", ["zz"], "data.test"),
        ("data.candidate", ["a"], "part of"),
        ("budget.value", 0, "budget"),
        ("budget.type", "steps", "budget"),
        ("model.backend", "other", "backend"),
        ("initialization.source", "moon", "source"),
        ("initialization.source", "parent", "parent_result"),
        ("select_policy.name", "best", "select_policy"),
        ("epoch_policy.name", "moving", "epoch_policy"),
    ],
)
def test_task_rules(task_config, key, value, message):
    config = task_config({"a": "a.yaml", "b": "b.yaml"})
    cfg.validate_task(config)
    cfg.put(config, key, value)
    with pytest.raises(cfg.ConfigError, match=message):
        cfg.validate_task(config)


def test_all_faults_are_told(task_config):
    config = task_config({"a": "a.yaml"})
    cfg.put(config, "budget.value", 0)
    cfg.put(config, "data.test", [])
    assert len(cfg.TASK.faults(config)) == 2


def test_unknown_and_missing_sections(task_config):
    with pytest.raises(cfg.ConfigError, match="unknown fields"):
        cfg.validate_task(task_config({"a": "a"}) | {"extra": 1})
    with pytest.raises(cfg.ConfigError, match="'budget'"):
        cfg.validate_task(task_config({"a": "a"}) | {"budget": 1})


SEQUENCE = {
    "sequence": {"label": "s", "seed": 40, "output_root": "/o"},
    "arrivals": [{"id": "a", "data": "a.yaml"}, {"id": "b", "data": "b.yaml"}],
    "scope_rule": {"candidate": "all_seen", "evaluation": "seen"},
    "initialization": {"first": {"source": "pretrained", "checkpoint": "w"}, "subsequent": {"source": "parent", "checkpoint": "last"}},
    "task_template": {"model": {"backend": "stub"}},
    "task_overrides": {"b": {"budget": {"value": 7}, "data": {"current": ["zz"]}}, "unknown": {"budget": {"value": 9}}},
}


def test_task_of_a_sequence_is_layered_and_its_identity_is_fixed():
    first = cfg.task_of(SEQUENCE, 0, {"a": "a.yaml"}, None, "/o/tasks")
    second = cfg.task_of(SEQUENCE, 1, {"a": "a.yaml", "b": "b.yaml"}, "/o/tasks/0", "/o/tasks")
    assert (first["budget"]["value"], second["budget"]["value"]) == (100, 7)
    assert second["data"] == {"catalog": {"a": "a.yaml", "b": "b.yaml"}, "current": ["b"], "candidate": ["a", "b"], "validation": ["a", "b"], "test": ["a", "b"]}
    assert second["task"] == {"name": "001", "label": "s", "seed": 41, "parent_result": "/o/tasks/0", "output_root": "/o/tasks"}
    other = cfg.overlay(SEQUENCE, {"scope_rule": {"candidate": "current", "evaluation": "anything"}})
    assert cfg.task_of(other, 1, {"a": "a", "b": "b"}, "/p", "/o")["data"]["test"] == ["b"]


@pytest.mark.parametrize(("key", "value"), [("arrivals", []), ("arrivals", [{"id": "a", "data": "x"}, {"id": "a", "data": "y"}]), ("arrivals", [{"id": "a"}]), ("scope_rule", {"candidate": "some"}), ("sequence", {}), ("initialization", {"first": {}}), ("more", 1)])
def test_sequence_rules(key, value):
    cfg.validate_sequence(SEQUENCE)
    with pytest.raises(cfg.ConfigError):
        cfg.validate_sequence(SEQUENCE | {key: value})


def test_dump_leaves_private_keys_out():
    assert cfg.parse(cfg.dump({"a": "é", "_b": 1})) == {"a": "é"}
