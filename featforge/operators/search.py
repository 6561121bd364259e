"""Vector search: best gallery match per probe, with a rejection class."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Bytes of vectors in a gallery tile and in a block of probes; tiles are cut from stretches of so many tiles.
TILE_BYTES, BLOCK_BYTES, STRETCH = 1 << 20, 1 << 18, 32
#: A large gallery lies in about so many tiles, larger than asked for, and blocks are as large: a probe travels at most once
#: for each. Bytes of the largest tiles and of the rows a task holds to cut them; similarities computed at once.
TILES, MOST_BYTES, HELD_BYTES, PAIRS = 64, 1 << 23, 1 << 26, 1 << 21
#: Tiles listed in one page of the directory, on average.
PAGE_TILES = 2048
#: Similarities are rounded to so many digits, so that equal means equal; angles (in radians) this close may tie.
DIGITS, SAME_ANGLE = 9, 1e-4


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; NULL for a zero vector."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q)
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have ``width`` finite components and a direction, and the numbers of those rows."""
    values, start = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    full = np.flatnonzero((np.diff(start) == width) & column.is_valid().to_numpy(zero_copy_only=False)) if width else np.zeros(0, int)
    m = values[start[full][:, None] + np.arange(width)].astype("float64")
    norms = np.sqrt((m * m).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return m[good] / norms[good, None], full[good]


def _groups(m: np.ndarray, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Row numbers in groups of at most ``most``, cut along the line between two far points at the widest gap of the middle half."""
    if len(rows) <= most:
        yield rows
        return
    own = m[rows]
    far = own[np.argmin(own @ own.mean(axis=0))]
    along = own @ (far - own[np.argmin(own @ far)])
    order = np.argsort(along, kind="stable")
    first = len(rows) // 4
    cut = first + 1 + int(np.argmax(np.diff(along[order][first:len(rows) - first])))
    for part in (order[:cut], order[cut:]):
        yield from _groups(m, rows[part], most)


def _pack(width: int, most: int, keep_rest: bool) -> Callable:
    """Arrow batches (key, id, vector) to groups: keys, ids, matrix, mean direction, greatest and least angle to it.

    Groups are cut from stretches of ``STRETCH`` groups, fewer where those are large. Rows without a usable vector are dropped or, with
    ``keep_rest``, go on in groups without a matrix.
    """
    held_rows = max(most, min(most * STRETCH, HELD_BYTES // (8 * max(1, width))))

    def emit(keys: pa.Array, ids: pa.Array, m: np.ndarray | None) -> pa.RecordBatch:
        near = far = mean = data = None
        if m is not None:
            centre = m.sum(axis=0)
            norm = np.sqrt((centre * centre).sum())
            centre = centre / norm if norm > 1e-9 else m[0]
            angles = np.arccos(np.clip(m @ centre, -1, 1))
            near, far, mean, data = float(angles.min()), float(angles.max()), centre.tolist(), m.tobytes()
        return pa.RecordBatch.from_arrays(
            [_listed(keys), _listed(ids), pa.array([data], pa.binary()), pa.array([mean], pa.list_(pa.float64())),
             pa.array([far], pa.float64()), pa.array([near], pa.float64())], ["keys", "ids", "matrix", "mean", "far", "near"])

    def cut(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, ids = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
        m = np.concatenate([h[2] for h in held])
        for rows in _groups(m, np.arange(len(m)), most):
            rows = np.sort(rows)
            yield emit(keys.take(pa.array(rows)), ids.take(pa.array(rows)), m[rows])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            m, good = _vectors(batch.column(2), width)
            rest = np.setdiff1d(np.arange(batch.num_rows), good)
            if keep_rest and len(rest):
                yield emit(batch.column(0).take(pa.array(rest)), batch.column(1).take(pa.array(rest)), None)
            if len(good):
                held.append((batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), m))
                n += len(good)
            if n >= held_rows:
                yield from cut(held)
                held, n = [], 0
        if held:
            yield from cut(held)
    return pack


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _tiles(gallery: DataFrame, gallery_id: str, vector: str, width: int, most: int) -> DataFrame:
    """The gallery as rows (tile, keys, matrix, mean, far, near) of bounded bytes, written once."""
    rows = gallery.select(F.col(gallery_id).cast("long").alias("k"), F.col(gallery_id).cast("long").alias("i"),
                          F.col(vector).cast("array<double>").alias("v")).filter("k IS NOT NULL AND v IS NOT NULL")
    packed = rows.mapInArrow(_pack(width, most, False), "keys array<long>, ids array<long>, matrix binary, mean array<double>, far double, near double")
    return stored(packed.withColumn("tile", F.monotonically_increasing_id()).drop("ids"), "tiles")


def _reachable(block_mean: Column, block_far: Column, tiles: Column) -> Column:
    """Numbers of the tiles that can hold the best match of a row of the block.

    By the triangle inequality of angles some vector of a tile lies within (angle of the means + both spreads) of every
    row, and none nearer than (angle of the means - both spreads).
    """
    def angle(t: Column) -> Column:
        dot = F.aggregate(F.zip_with(block_mean, t["mean"], lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))

    bounds = F.transform(tiles, lambda t: F.struct(t["tile"].alias("tile"), angle(t).alias("a"), t["far"].alias("far"), t["near"].alias("near")))
    reach = F.array_min(F.transform(bounds, lambda b: b["a"] + block_far + b["near"])) + SAME_ANGLE
    return F.transform(F.filter(bounds, lambda b: b["a"] - block_far - b["far"] <= reach), lambda b: b["tile"])


def _nearest(probes: np.ndarray, gallery: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the largest rounded similarity of every probe, the first of equal ones, and that similarity."""
    at, sim = np.empty(len(probes), dtype="int64"), np.empty(len(probes))
    step = max(1, PAIRS // max(1, len(gallery)))
    for first in range(0, len(probes), step):
        s = probes[first:first + step] @ gallery.T
        top = s.max(axis=1)
        best = np.round(top, DIGITS)
        row, col = np.nonzero(s >= (top - 2 * 10.0 ** -DIGITS)[:, None])  # only these can be equal when rounded
        same = np.round(s[row, col], DIGITS) == best[row]
        _, where = np.unique(row[same], return_index=True)
        at[first:first + step], sim[first:first + step] = col[same][where], best + 0.0
    return at, sim


def _best(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Best gallery id of a tile for every row of a block, ties to the lowest; NULL where there is no tile or vector."""
    for batch in batches:
        keys, ids, matrix, gallery, tile = batch.columns
        for i in range(batch.num_rows):
            rows, names = keys[i].values, ids[i].values
            idx, sim = np.full(len(rows), -1), np.full(len(rows), np.nan)
            if tile[i].is_valid:
                probes = np.frombuffer(matrix[i].as_buffer()).reshape(-1, width)
                numbers = gallery[i].values.to_numpy()
                order = np.argsort(numbers, kind="stable")
                at, sim = _nearest(probes, np.frombuffer(tile[i].as_buffer()).reshape(-1, width)[order])
                idx = numbers[order][at]
            none = np.isnan(sim)
            yield pa.RecordBatch.from_arrays([rows, names, pa.array(idx, pa.int64(), mask=none), pa.array(sim, mask=none)], ["row", "id", "idx", "sim"])


def _visits(probes: DataFrame, probe_id: str, vector: str, width: int, tiles: DataFrame, pages: int, block_rows: int = 1) -> DataFrame:
    """Blocks of probes, of ``block_rows`` or more, once for every tile they have to meet (NULL: none)."""
    directory = (tiles.groupBy(F.pmod(F.xxhash64("tile"), F.lit(pages)).alias("page"))
                 .agg(F.collect_list(F.struct("tile", "mean", "far", "near")).alias("listed")))
    kind = probes.schema[probe_id].dataType.simpleString()
    rows = probes.select(F.monotonically_increasing_id().alias("k"), F.col(probe_id).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    blocks = rows.mapInArrow(_pack(width, max(block_rows, BLOCK_BYTES // (8 * max(1, width))), True),
                             f"keys array<long>, ids array<{kind}>, matrix binary, mean array<double>, far double, near double")
    return (blocks.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))).join(directory, "page", "left")
            .withColumn("tile", F.explode_outer(F.when(F.col("matrix").isNotNull(), _reachable(F.col("mean"), F.col("far"), F.col("listed"))))))


def top_match(probes: DataFrame, gallery: DataFrame, probe_id: str, gallery_id: str, vector: str,
              threshold: float = 0.75, reject: int | None = None, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Best gallery id per probe by cosine similarity, ``reject`` below the threshold.

    ``gallery_id`` is an integer. Ties go to the lowest one. ``reject`` defaults to the gallery size. Returns
    probe id, ``idx``, ``sim``, ``class``, one row per probe row: ids of probes may be NULL or repeat, and so may those
    of the gallery (NULL matches nothing). Exact. Vectors of another length than the gallery's longest, without a
    direction or with a component that is not finite match nothing.

    Tasks pack the gallery into tiles and the probes into blocks, neighbours together. A block meets the tiles that can
    hold a best match of its rows, and no others; the best of its tiles is each row's result. ``tile_bytes`` is the
    least size of a tile: a large gallery lies in about ``TILES`` larger ones, up to ``MOST_BYTES``, and blocks grow with
    them, so that what travels grows with the rows and not with their pairs. No vector meets the driver. A small table of tiles travels to the probes, a large one is joined by tile number.
    """
    size, width = gallery.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    width = max(width, 0)
    row_bytes = 8 * max(1, width)
    spread = min(-(-size // TILES), MOST_BYTES // row_bytes)
    most = max(1, tile_bytes // row_bytes, spread)
    tiles = _tiles(gallery, gallery_id, vector, width, most)
    visits = _visits(probes, probe_id, vector, width, tiles, 1 + size // (most * PAGE_TILES), max(1, spread))
    right = tiles.select("tile", F.col("keys").alias("gallery"), F.col("matrix").alias("vectors"))
    kind = probes.schema[probe_id].dataType.simpleString()
    scored = visits.join(right, "tile", "left").select("keys", "ids", "matrix", "gallery", "vectors").mapInArrow(
        lambda batches: _best(batches, width), f"row long, id {kind}, idx long, sim double")
    best = scored.groupBy("row", "id").agg(F.max(F.when(F.col("idx").isNotNull(), F.struct("sim", (-F.col("idx")).alias("i")))).alias("m"))
    found = best.select(F.col("id").alias(probe_id), (-F.col("m.i")).alias("idx"), F.col("m.sim").alias("sim"))
    cls = F.when(F.col("sim") >= threshold, F.col("idx")).otherwise(F.lit(size if reject is None else reject))
    return found.withColumn("class", cls.cast("long"))
