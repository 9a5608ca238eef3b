"""Trees and manifests as tasks list them, against what the machine's own library lists."""

import os
from pathlib import Path

import pytest

from tidemark.operators.registry import IntegrityError
from tidemark.sources import files, images, listing


def tree(root, depth, width):
    """Folders in folders, with images, other files, hidden and odd names, and links."""
    root.mkdir(parents=True)
    for i in range(width):
        (root / f"{i}.JPG").write_bytes(b"")
        (root / f"note {i}.txt").write_text("x")
    (root / ".hidden.png").write_bytes(b"x")
    (root / "_a, [b]{c}*.webp").write_bytes(b"x")
    if depth:
        for i in range(width):
            tree(root / f"d{i}.jpg" if i == 0 else root / f"_d{i}", depth - 1, width)


def entries(spark, *paths):
    return spark.createDataFrame(list(enumerate(map(str, paths))), listing.ENTRY)


def test_walk_finds_all_files_of_all_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "FOLDERS", 2)
    monkeypatch.setattr(listing, "ROWS", 3)
    tree(tmp_path / "t", 3, 2)
    (tmp_path / "empty").mkdir()
    (tmp_path / "t" / "loop").symlink_to(tmp_path / "t")
    (tmp_path / "t" / "link.jpg").symlink_to(tmp_path / "t" / "0.JPG")
    (tmp_path / "t" / "gone.jpg").symlink_to(tmp_path / "nowhere")
    found = listing.walk(entries(spark, tmp_path / "t", tmp_path / "empty"), "", str(tmp_path / "out")).collect()
    want = sorted(os.path.join(d, f) for d, _, names in os.walk(tmp_path / "t") for f in names if Path(d, f).is_file())
    assert sorted(r["path"] for r in found) == want and {r["entry"] for r in found} == {0}
    assert listing.walk(entries(spark), "", str(tmp_path / "none")).count() == 0
    assert sorted(files.below(spark, str(tmp_path / "t" / "_d1"))) == sorted(f"file:{p}" for p in map(str, (tmp_path / "t" / "_d1").rglob("*")) if Path(p).is_file())


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_lines_of_manifests_in_ranges_of_any_size(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(listing, "RANGE", size)
    texts = {"a.txt": "one\ntwo\r\n\n  three  \nfo ur", "_b.txt": "\n\nüé/x.jpg\n\tlast\n", "c.txt": "", "d.txt": "x\rold line\n" + "y" * 90}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    kinds = listing.kinds(entries(spark, *(tmp_path / n for n in texts)), "")
    got = sorted((r["entry"], r["line"]) for r in listing.lines(kinds.where("kind = 'manifest'"), "").collect())
    assert got == sorted((i, line.strip()) for i, t in enumerate(texts.values()) for line in t.splitlines() if line.strip())


def test_kinds(spark, tmp_path):
    (tmp_path / "x.TXT").write_text("a")
    (tmp_path / "i.JpG").write_bytes(b"")
    (tmp_path / "n.doc").write_text("a")
    named = [tmp_path, tmp_path / "x.TXT", tmp_path / "i.JpG", tmp_path / "n.doc", tmp_path / "gone.jpg", f"file://{tmp_path}/i.JpG"]
    assert [r["kind"] for r in listing.kinds(entries(spark, *named), "").orderBy("entry").collect()] == ["folder", "manifest", "image", "none", "none", "image"]


def specs(tmp_path, n):
    out = {}
    for i in range(n):
        root = tmp_path / f"g{i}"
        for split in images.SPLITS:
            (root / "images" / split).mkdir(parents=True, exist_ok=True)
            for j in range(1 + i % 3):
                (root / "images" / split / f"{j}.jpg").write_bytes(b"")
        (root / "more.txt").write_text(f"images/train/0.jpg\n./images/extra/{i}.png\n")
        out[f"g{i}"] = images.Descriptor("", str(root), ("a",), {"train": ("images/train", "more.txt"), "val": ("images/val",), "test": ("images/test/0.jpg",)})
    return out


def test_a_catalogue_of_many_groups_is_one_plan(spark, tmp_path):
    many = specs(tmp_path, 300)
    found = images.catalogue(spark, many)
    rows = {(r["group"], r["split"], r["sample_id"]) for r in found.collect()}
    want = {(g, s, f"{g}::images/{s}/{j}.jpg") for i, g in enumerate(many) for s in ("train", "val") for j in range(1 + i % 3)}
    want |= {(g, "test", f"{g}::images/test/0.jpg") for g in many} | {(g, "train", f"{g}::images/extra/{i}.png") for i, g in enumerate(many)}
    assert rows == want
    few = images.catalogue(spark, {g: many[g] for g in list(many)[:2]})
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(found) == size(few)
    through = images._through_driver(spark, entries(spark, tmp_path / "g1" / "images", tmp_path / "g1" / "more.txt", tmp_path / "g1" / "images" / "test" / "0.jpg"))
    assert sorted(r["path"].removeprefix("file:").removeprefix(str(tmp_path)) for r in through.where("entry <> 1").collect()) == sorted([f"/g1/images/{s}/{j}.jpg" for s in images.SPLITS for j in range(2)] + ["/g1/images/test/0.jpg"])


def test_faults_of_a_catalogue(spark, tmp_path):
    many = specs(tmp_path, 3)
    (tmp_path / "g1" / "images" / "val" / "0.jpg").unlink()
    (tmp_path / "g1" / "images" / "val" / "1.jpg").unlink()
    with pytest.raises(IntegrityError, match=r"no images in \['images/val'\] \(val of g1\)"):
        images.catalogue(spark, many)
    (tmp_path / "g2" / "more.txt").unlink()
    with pytest.raises(FileNotFoundError, match="g2/more.txt"):
        images.catalogue(spark, many)
