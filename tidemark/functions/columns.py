"""Column expressions: names, paths, numbers and costs.  Everything stays in the JVM."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of files that count as images, compared in lower case.
IMAGE_SUFFIXES = ("bmp", "dng", "heic", "jpeg", "jpg", "mpo", "pfm", "png", "tif", "tiff", "webp")

#: A component that labels are found by.
IMAGES_FOLDER = r"(?i)/images(/|$)"

#: Separates the group from the path in a sample id.
ID_MARK = "::"


def sample_id(group: Column, relative: Column) -> Column:
    """Stable across machines: no absolute path is part of it."""
    return F.concat_ws(ID_MARK, group, relative)


def suffix(path: Column) -> Column:
    """What follows the last dot of the last path component, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_image(path: Column) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES)


def relative_path(path: Column, root: str | Column) -> Column:
    """``path`` below ``root``; the query fails for a path outside of it."""
    root = F.lit(root) if isinstance(root, str) else root
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(inside, F.substr(path, F.length(root) + 2)).otherwise(F.raise_error(F.concat(F.lit("not below the dataset root: "), path)))


def label_path(path: Column) -> Column:
    """Where the labels of an image are: the last ``images`` component becomes ``labels``, the suffix ``.txt``.

    Components are compared without case.  The query fails for a path without
    such a component.
    """
    moved = F.regexp_replace(path, r"(?i)^(.*/)images(?=/|$)(.*)$", "$1labels$2")
    named = F.concat(F.regexp_replace(moved, r"(?<=[^/])\.[^./]+$", ""), F.lit(".txt"))
    return F.when(path.rlike(IMAGES_FOLDER), named).otherwise(F.raise_error(F.concat(F.lit("no images directory in: "), path)))


@cache
def folding() -> tuple[str, str, dict[str, str]]:
    """Full case folding: characters and the ones they become, and those that become several.

    Made from Python's table of Unicode, so no list of them stands here.
    """
    changed = {c: f for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and (f := c.casefold()) != c}
    single = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in changed.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full case folding as Python's ``casefold``: what differs in case only becomes equal, sharp s and SS too.

    Texts of ASCII, nearly all paths, only go to lower case.  Of the characters that
    become several only those that a text holds are looked for again, so it is gone
    through a few times, not once for each that there is.
    """
    before, after, several = folding()
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    held = F.array_distinct(F.regexp_extract_all(text, F.lit(f"[\\x{{80}}-\\x{{10FFFF}}&&[{''.join(several)}]]"), F.lit(0)))
    full = F.aggregate(held, F.translate(text, before, after), lambda folded, c: F.replace(folded, c, table[c]))
    return F.when(text.rlike(r"[^\x00-\x7F]"), full).otherwise(F.lower(text))


def owner_key(path: Column) -> Column:
    """What two paths share if a file system without case can't tell them apart."""
    return casefold(path)


def sanitize(value: Column, maximum: int = 80) -> Column:
    """A text as part of a file name: runs of reserved characters and white space become one hyphen."""
    plain = F.regexp_replace(value, r'(?U)[<>:"/\\|?*\s]+', "-")
    return F.substring(F.coalesce(F.nullif(F.btrim(plain, F.lit("-. ")), F.lit("")), F.lit("run")), 1, maximum)


def strip(value: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def number(value: Column) -> Column:
    """The double that a text cell holds, null if it holds something else.

    Python's spelling of numbers: underscores between digits count, type
    suffixes such as ``1d`` do not.
    """
    text = strip(value)
    grouped = F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")
    shape = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"
    return F.when(grouped.rlike(shape), grouped.try_cast("double"))


def stem(path: Column) -> Column:
    """The last path component without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]+$", "")


def task_name(index: Column) -> Column:
    return F.format_string("%03d", index)


def optimizer_steps(samples: Column, batch: Column | int, epochs: Column | int) -> Column:
    """Batches of all epochs; a batch below one counts as one."""
    batch = F.lit(batch) if isinstance(batch, int) else batch
    epochs = F.lit(epochs) if isinstance(epochs, int) else epochs
    return (F.ceil(samples / F.greatest(F.lit(1), batch)) * epochs).cast("long")


def gpu_hours(seconds: Column, devices: Column | int) -> Column:
    devices = F.lit(devices) if isinstance(devices, int) else devices
    return seconds * F.greatest(F.lit(0), devices) / 3600.0


def device_count(devices: Column, listed: Column) -> Column:
    """``devices``: a name; ``listed``: an array of devices or null, which goes first."""
    return F.when(listed.isNotNull(), F.size(listed)).when(F.lower(devices) == "cpu", 0).otherwise(1)


def names_in_order(names: Column) -> Column:
    """The values of a map from class number to name, by number; the query fails unless numbers run from 0."""
    pairs = F.array_sort(F.map_entries(names))
    run = F.transform(pairs, lambda x, i: x["key"] == i)
    return F.when(F.forall(run, lambda x: x), F.transform(pairs, lambda x: x["value"])).otherwise(F.raise_error(F.lit("class numbers must run from 0")))
