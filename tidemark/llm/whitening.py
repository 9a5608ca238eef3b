"""Whitening of vectors by a tiled covariance.

Entries become whole numbers, so sums over all vectors are exact whatever the
order.  The covariance is made in tiles:

1.  Each task cuts its rows into row blocks, and each of these into column blocks
    of ``side`` dimensions, kept as whole numbers of the narrowest type.  A pair of
    column blocks is the key of a tile of dimension pairs.
2.  Column blocks are shuffled by row block.  Where a row block has come together,
    its columns are centred and multiplied, tile by tile, and added to what the
    partition has for that tile.
3.  The sums of the partitions are added per tile.  The driver assembles the tiles
    and finds the eigenvectors.

What meets on the driver is the covariance, dimensions x dimensions, never vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Dimensions of a tile's side at least, and sides of the matrix at most.
SIDE, SIDES = 32, 8
#: Dimensions up to which the covariance is assembled on the driver, in 128 MB.
MAX_DIMS = 4096
#: Entries of vectors that a task takes at a time, and bytes of column blocks that meet in a partition, about.
ENTRIES, PARTITION_BYTES = 1 << 19, 32 << 20
#: Part of the largest eigenvalue below which one is rounding, and its component has no scale.
LEAST = 1e-12
#: Whole numbers end here: an entry beyond is held at the end.
END = 1 << 62
KINDS = ("int8", "int16", "int32", "int64", "float64")


@dataclass(frozen=True)
class Fit:
    """n vectors, exact sums per dimension, and up to ``COMPONENTS`` components by falling eigenvalue (columns)."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scaled(self) -> np.ndarray:
        """Components over the roots of their eigenvalues; nan where that is rounding."""
        sound = (self.values > 0) & (self.values > LEAST * self.values.max(initial=0))
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.components / np.where(sound, np.sqrt(np.where(sound, self.values, 1)), np.nan)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows whose vector is not null and holds no null or non-finite entry."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.coalesce(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False)))


def whole(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of whole numbers; what a vector lacks at its end counts as entries of 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)), -END, END).astype(np.int64) + SHIFT
    if len(flat) == len(sizes) * dims:
        return flat.reshape(len(sizes), dims)
    out = np.full((len(sizes), dims), SHIFT, np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    step = max(1, ENTRIES // max(dims, 1))
    for batch in batches:
        for first in range(0, len(batch), step):
            yield batch.slice(first, step)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, n, total) of one partition: entries at a place of the vectors and their sum; place -1 counts vectors."""
    rows, counts, totals = 0, np.zeros(0, np.int64), np.zeros(0, object)
    for batch in batches:
        sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
        rows += len(batch)
        order = np.argsort(sizes, kind="stable")  # equal lengths together, so nothing is padded
        for own in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            dims = int(sizes[own[0]]) if len(own) else 0
            for part in _slices([batch.take(pa.array(own))] if dims else [], dims):
                x = whole(part.column("embedding"), dims)
                small = np.abs(x).max() < END // max(len(x), 1)
                if dims > len(counts):
                    counts, totals = np.append(counts, np.zeros(dims - len(counts), np.int64)), np.append(totals, np.full(dims - len(totals), 0, object))
                counts[:dims] += len(x)
                totals[:dims] += (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
    places = pa.array(np.arange(-1, len(counts)), pa.int32())
    yield pa.RecordBatch.from_arrays([places, pa.array([rows, *counts.tolist()], pa.int64()), pa.array([Decimal(0), *map(Decimal, totals.tolist())], pa.decimal128(38, 0))], names=["place", "n", "total"])


def sums_of(vectors: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and exact sums of their whole numbers per dimension."""
    parts = vectors.select("embedding").mapInArrow(_sums, "place int, n bigint, total decimal(38,0)")
    found = {r["place"]: r for r in parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where(f"place <= {MAX_DIMS}").collect()}
    n = found[-1]["n"] if found else 0
    if len(found) > MAX_DIMS + 1:
        raise ValueError(f"a vector has more than {MAX_DIMS} entries; the covariance of so many does not fit on the driver")
    return n, tuple(int(found[j]["total"]) + (n - found[j]["n"]) * SHIFT for j in range(len(found) - 1))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them."""
    if x.dtype.kind == "f":
        return x
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(k for k in KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def side_of(dims: int) -> int:
    return max(SIDE, -(-dims // SIDES))


def covariance(rows: DataFrame, dims: int, matrix: Callable[[pa.RecordBatch], np.ndarray], centre: np.ndarray, n: int, width: int) -> np.ndarray:
    """The covariance, divisor n, of the rows that ``matrix`` makes of batches, after ``centre`` is taken from them.

    ``width`` is the number of bytes of an entry, about, by which partitions are sized.
    """
    side = side_of(dims)
    blocks = pa.schema([("row_block", pa.int64()), ("col_block", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        for number, batch in enumerate(_slices(batches, dims)):
            x = matrix(batch)
            own = [_narrow(x[:, j : j + side]) for j in range(0, dims, side)]
            columns = [[base + number] * len(own), range(len(own)), [str(o.dtype) for o in own], [np.ascontiguousarray(o).tobytes() for o in own]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, blocks, strict=True)], schema=blocks)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        block, own = None, {}

        def close() -> None:
            for i, a in own.items():
                for j, b in own.items():
                    if i <= j:
                        done = a.T @ b
                        tiles[i, j] = tiles[i, j] + done if (i, j) in tiles else done

        for batch in batches:
            for row in range(len(batch)):
                at, col, kind, data = (batch.column(c)[row] for c in range(4))
                if at.as_py() != block:
                    close()
                    block, own = at.as_py(), {}
                first = col.as_py() * side
                mean = centre[first : first + side]
                own[col.as_py()] = np.frombuffer(data.as_buffer(), kind.as_py()).reshape(-1, len(mean)) - mean
        close()
        yield _packed(tiles)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own = np.frombuffer(data)
                tiles[i, j] = tiles[i, j] + own if (i, j) in tiles else own
        yield _packed(tiles)

    tile = "i int, j int, data binary"
    pieces = rows.mapInArrow(cut, "row_block bigint, col_block int, kind string, data binary")
    parts = -(-n * dims * width // PARTITION_BYTES)
    met = pieces.repartition(max(1, parts), "row_block").sortWithinPartitions("row_block", "col_block").mapInArrow(multiply, tile)
    sides = -(-dims // side)
    summed = met.repartition(sides * (sides + 1) // 2, "i", "j").mapInArrow(add, tile)
    out = np.zeros((dims, dims))
    for r in summed.toLocalIterator():
        a, b = slice(r["i"] * side, min((r["i"] + 1) * side, dims)), slice(r["j"] * side, min((r["j"] + 1) * side, dims))
        out[a, b] = np.frombuffer(r["data"]).reshape(a.stop - a.start, b.stop - b.start)
        out[b, a] = out[a, b].T
    return out / n


def _packed(tiles: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(tiles)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([np.ascontiguousarray(tiles[k]).tobytes() for k in keys], pa.binary())], names=["i", "j", "data"]
    )


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit:
    """The components of all usable vectors (see :func:`usable`): unit eigenvectors, the largest entry of each positive."""
    n, sums = sums_of(vectors)
    if not n or not sums:
        return Fit(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    mean, dims = np.array([s / n for s in sums]), len(sums)
    matrix = lambda batch: whole(batch.column("embedding"), dims) - SHIFT  # noqa: E731  small numbers, so narrow types hold them
    found = covariance(vectors.select("embedding"), dims, matrix, mean - SHIFT, n, 2)
    values, own = np.linalg.eigh(found)
    values, own = np.maximum(values[::-1], 0)[:components], own[:, ::-1][:, :components]
    own = own * np.where(own[np.abs(own).argmax(axis=0), np.arange(own.shape[1])] < 0, -1.0, 1.0)
    return Fit(n, sums, values, own, float(np.trace(found)))


def _deviations(x: np.ndarray, fit: Fit) -> pa.Array:
    """The sum over dimensions of (n * x - S)^2 of each row, exact; null where a long can't hold it."""
    about = ((fit.n * (x - fit.mean)) ** 2).sum(axis=1)
    sums = np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in fit.sums], np.int64)
    with np.errstate(over="ignore"):  # where the sum fits, so does what it adds, whatever wraps on the way
        exact = ((x * np.int64(fit.n) - sums) ** 2).sum(axis=1)
    near = np.flatnonzero((about > 9.1e18) & (about < 9.4e18))
    kept = about <= 9.1e18
    for i in near.tolist():
        value = sum((fit.n * v - s) ** 2 for v, s in zip(x[i].tolist(), fit.sums, strict=True))
        if value < 1 << 63:
            exact[i], kept[i] = value, True
    return pa.array(exact, mask=~kept)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    ``vectors`` has vec_id bigint and embedding, an array of numbers; other columns
    are ignored.  Rows with a null vector, or one that holds a null or non-finite
    entry, are dropped; zero vectors, repeated rows and null ids stay, each row for
    itself.  A vector shorter than others counts as having entries of 0 behind its
    end; one with more than ``MAX_DIMS`` entries is refused.  A component whose
    eigenvalue is rounding (``LEAST``) has a null ``whitened`` and is left out of
    ``identity_error``; ``explained`` is null where all vectors are equal.
    ``deviation`` is null where it is beyond a long.  No usable vectors, or only empty
    ones, give an empty result.
    """
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = usable(vectors)
    own = fit(rows, components)
    if not own.values.size:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, mean, scaled = len(own.sums), own.mean, own.scaled
    sound = ~np.isnan(scaled).any(axis=0)
    project = lambda batch: (whole(batch.column("embedding"), dims) - mean) @ scaled
    error = None
    if sound.any():  # projections of centred vectors are centred
        seen = covariance(rows.select("embedding"), int(sound.sum()), lambda batch: project(batch)[:, sound], np.zeros(int(sound.sum())), own.n, 8)
        error = float(np.abs(seen - np.eye(len(seen))).max())
    explained = own.values / own.trace if own.trace > 0 else np.full(len(own.values), np.nan)
    width = len(own.values)
    out = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, max(dims, width)):
            x, count = whole(batch.column("embedding"), dims), len(batch)
            each = pa.array(np.repeat(np.arange(count), width))
            values = ((x - mean) @ scaled).reshape(-1)
            told = np.tile(explained, count)
            columns = [
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)), pa.array(np.full(count * width, own.n)), _deviations(x, own).take(each),
                pa.array(values, mask=np.isnan(values)), pa.array(told, mask=np.isnan(told)), pa.array([error] * (count * width), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return rows.mapInArrow(run, schema)
