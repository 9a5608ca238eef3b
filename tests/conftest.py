"""One session for all tests, and small image datasets."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark import config  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
    builder = builder.config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def dataset(tmp_path):
    """Makes a group: two train images, one for validation, one for tests."""

    def make(name: str, names="{0: object}", counts=(("train", 2), ("val", 1), ("test", 1))) -> str:
        for split, n in counts:
            folder = tmp_path / "data" / name / "images" / split
            folder.mkdir(parents=True)
            for i in range(n):
                (folder / f"{name}_{split}_{i}.jpg").write_bytes(b"x")
        path = tmp_path / "data" / f"{name}.yaml"
        path.write_text(f"path: {tmp_path}/data/{name}\ntrain: images/train\nval: images/val\ntest: [images/test]\nnames: {names}\n")
        return str(path)

    return make


@pytest.fixture
def task_config(tmp_path):
    """A task over all groups of a catalog, the last being current, on top of the defaults."""

    def make(catalog: dict[str, str], **more) -> dict:
        roles = dict.fromkeys(("candidate", "validation", "test"), list(catalog))
        mine = {
            "budget": {"value": 2},
            "data": {"catalog": catalog, "current": [list(catalog)[-1]], **roles},
            "initialization": {"checkpoint": "net.pt", "source": "pretrained"},
            "model": {"definition": "net.yaml", "backend": "stub"},
            "task": {"name": "t", "label": "unit", "seed": 3, "output_root": str(tmp_path / "out")},
        }
        return config.overlay(config.DEFAULTS, mine, {"backend": {"params": {"batch": 3}}}) | more

    return make
