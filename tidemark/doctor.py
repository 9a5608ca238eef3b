"""What the engine runs on, and whether that will do."""

from __future__ import annotations

import importlib.metadata
import importlib.util
import platform
from pathlib import Path
from typing import Any

PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy", "PyYAML")
#: The first version of each that the engine is written for.
NEEDED = {"python": (3, 11), "pyspark": (4, 0), "pyarrow": (15,), "numpy": (1, 26)}
#: Versions that the training backend is pinned to, and the Python that it is tested with.
TRAINING = {"torch": "2.6.0", "torchvision": "0.21.0", "ultralytics": "8.4.102"}
TRAINING_PYTHON = "3.11"


def _version(text: str | None) -> tuple[int, ...]:
    return tuple(int(p) for p in (text or "").split("+")[0].split(".") if p.isdigit())


def _installed(name: str) -> str | None:
    try:
        return importlib.metadata.version(name)
    except importlib.metadata.PackageNotFoundError:
        return None


def _devices() -> dict[str, Any]:
    """What the training library sees of accelerators; nothing where it isn't installed."""
    if importlib.util.find_spec("torch") is None:
        return {"cuda_available": False, "gpus": []}
    import torch

    names = [torch.cuda.get_device_name(i) for i in range(torch.cuda.device_count())]
    return {"cuda": torch.version.cuda, "cuda_available": torch.cuda.is_available(), "gpus": names}


def report(project_root: Path | None = None, training: bool = False) -> dict[str, Any]:
    """Versions, and by name_ok whether each will do; ``training`` adds the pinned stack, ``project_root`` where the package must lie."""
    found: dict[str, Any] = {"python": platform.python_version()} | {name: _installed(name) for name in PACKAGES}
    found |= {f"{name}_ok": _version(found[name]) >= least for name, least in NEEDED.items()}
    if training:
        have = {name: _installed(name) for name in TRAINING}
        found |= have | {f"{name}_ok": (have[name] or "").split("+")[0] == pinned for name, pinned in TRAINING.items()}
        found |= {"training_python_ok": found["python"].startswith(TRAINING_PYTHON + ".")} | _devices()
    if project_root is not None:
        place = Path(__file__).resolve()
        found |= {"package_path": str(place), "package_path_ok": place.is_relative_to(project_root.resolve())}
    return found


def sound(found: dict[str, Any]) -> bool:
    return all(v for k, v in found.items() if k.endswith("_ok"))
