"""Class balancing by interpolation between near neighbours (Chawla et al., 2002)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import portable_hash, unit_interval
from ..session import stored
from .align import union_rows
from .ordered import dense_position

#: Rows of a tile, and reference points at most; a class uses as many of them as it has tiles.
TILE_ROWS, PIVOTS = 1024, 64
#: The rows of a large class would fill so many tiles, larger than asked for: a row travels at most once for each. Bytes of
#: the largest tiles; distances looked at and computed at once.
TILES, MOST_BYTES, PAIRS, EXACT = 32, 1 << 22, 1 << 20, 1 << 14
#: Rows that look together at a stretch of a tile.
LOOKING = 256
DISTANCE_DIGITS = 9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, rounded so that equal means equal; a few rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return np.round(out, DISTANCE_DIGITS)


def _below(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows (of ``a``, of ``b``) and their squared distances, all whose distance is at most ``limit`` of the row of ``a``.

    A matrix product finds the pairs, with room for its error; their distances are those of ``_distances``.
    """
    centre = b.mean(axis=0)
    x, y = a - centre, b - centre
    with np.errstate(over="ignore", invalid="ignore"):
        nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
        room = 1e-13 * (a.shape[1] + 16) * (nx + ny.max(initial=0)) + 10.0 ** -DISTANCE_DIGITS
        most = limit ** 2 * (1 + 1e-9) + room
    plain = not (np.isfinite(nx).all() and np.isfinite(ny).all())  # the product says nothing: look at every pair
    step = max(1, PAIRS // max(1, len(b)))
    for first in range(0, len(a), step):
        part = slice(first, first + step)
        if plain:
            row, col = (g.ravel() for g in np.indices((len(a[part]), len(b))))
        else:
            row, col = np.nonzero(nx[part, None] + ny[None, :] - 2 * (x[part] @ y.T) <= most[part, None])
        d = np.empty(len(row))
        with np.errstate(over="ignore", invalid="ignore"):
            for i in range(0, len(row), EXACT):
                diff = a[first + row[i:i + EXACT]] - b[col[i:i + EXACT]]
                d[i:i + EXACT] = np.einsum("ij,ij->i", diff, diff)
        d = np.round(d, DISTANCE_DIGITS)
        near = np.isfinite(d)
        near[near] = np.sqrt(d[near]) <= limit[first + row[near]]
        yield first + row[near], col[near], d[near]


def _first(row: np.ndarray, col: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` smallest distances of each row, ties to the lower column, in order."""
    order = np.lexsort((col, d, row))
    starts = np.flatnonzero(np.append(True, np.diff(row[order]) != 0)) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _vectors(column: pa.Array) -> np.ndarray:
    widths = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(widths) > 1:
        raise ValueError(f"vectors of several lengths: {widths.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), int(widths[0]) if len(widths) else 0)


def _matrix(cell: pa.Scalar, rows: int) -> np.ndarray:
    return np.frombuffer(cell.as_buffer()).reshape(rows, -1)


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _tiles(base: DataFrame, pivots: np.ndarray, tile_rows: int) -> DataFrame:
    """The rows of each class by nearest reference point and distance to it, in tiles (one row each), written once."""
    ktype, ltype = (base.schema[c].dataType.simpleString() for c in ("_k", "_l"))
    counts = stored(base.groupBy(F.col("_l").alias("_cl")).agg(F.count("*").alias("_n")), "classes")  # one row per class
    most = F.greatest(F.lit(tile_rows), F.least(F.ceil(F.col("_n") / TILES), F.lit(max(1, MOST_BYTES // (8 * max(1, pivots.shape[1]))))))
    used = F.least(F.lit(len(pivots)), F.ceil(F.col("_n") / most)).cast("int")
    sized = base.join(counts, F.col("_l").eqNullSafe(F.col("_cl"))).select("_k", "_l", "_w", "_v", used.alias("_u"), most.cast("int").alias("_t"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, used = _vectors(batch.column(3)), batch.column(4).to_numpy()
            d = np.sqrt(_distances(own, pivots)) if len(own) else np.zeros((0, len(pivots)))
            d[np.arange(len(pivots)) >= used[:, None]] = np.inf
            near = d.argmin(axis=1) if len(own) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(own)), near])], [*batch.schema.names, "_p", "_r"])

    placed = stored(sized.mapInArrow(place, f"_k {ktype}, _l {ltype}, _w boolean, _v array<double>, _u int, _t int, _p int, _r double"), "placed")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, on = [], 0, None

        def tile() -> pa.RecordBatch:
            t = pa.concat_batches(held)
            r = t.column(7).to_numpy()
            return pa.RecordBatch.from_arrays(
                [t.column(1)[:1], t.column(6)[:1], t.column(4)[:1], pa.array([len(r)]), pa.array([r.min()]), pa.array([r.max()]),
                 _listed(t.column(0)), _listed(t.column(2)), pa.array([_vectors(t.column(3)).tobytes()], pa.binary())],
                ["l", "p", "used", "n", "lo", "hi", "keys", "wanted", "matrix"])

        for batch in batches:
            cells = list(zip(batch.column(1).to_pylist(), batch.column(6).to_pylist()))
            most = batch.column(5).to_numpy()
            at = 0
            while at < len(cells):
                if n and (cells[at] != on or n == most[at]):
                    yield tile()
                    held, n = [], 0
                on, end = cells[at], at
                while end < len(cells) and cells[end] == on and end - at < most[at] - n:
                    end += 1
                held.append(batch.slice(at, end - at))
                n, at = n + end - at, end
        if n:
            yield tile()

    packed = placed.repartitionByRange("_l", "_p", "_r", "_k").sortWithinPartitions("_l", "_p", "_r", "_k").mapInArrow(
        pack, f"l {ltype}, p int, used int, n long, lo double, hi double, keys array<{ktype}>, wanted array<boolean>, matrix binary")
    return stored(packed.withColumn("tile", F.monotonically_increasing_id()), "tiles")


def _asking(tiles: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """Tiles with wanted rows: those rows, how far the k-th neighbour of each can be, and for each reference point the
    band of distances from it in which a neighbour can lie."""
    types = tiles.schema["l"].dataType.simpleString(), tiles.schema["keys"].dataType.simpleString()
    # A class has a bound for each reference point at most: a whole tile of more than k rows lies within it.
    full = (tiles.filter(F.col("n") > k).groupBy("l", "p").agg(F.min("hi").alias("hi"))
            .groupBy(F.col("l").alias("_bl")).agg(F.collect_list(F.struct("p", "hi")).alias("full")))
    some = tiles.filter(F.exists("wanted", lambda w: w))
    rows = some.join(stored(full, "bounds"), F.col("l").eqNullSafe(F.col("_bl")), "left").select(
        "l", "tile", "p", "used", "n", "keys", "wanted", "matrix", "full")

    def reach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                label, tile, p, used, n, keys, wanted, matrix, full = (c[i] for c in batch.columns)
                every, used = _matrix(matrix, n.as_py()), used.as_py()
                mine = np.flatnonzero(wanted.values.to_numpy(zero_copy_only=False))
                own = every[mine]
                to = np.sqrt(_distances(own, pivots[:used]))
                bound = np.full(len(own), np.inf)
                if len(every) > k:
                    step = max(1, 4 * PAIRS // every.size)
                    for i in range(0, len(own), step):  # one of the k + 1 nearest is the row itself
                        bound[i:i + step] = np.sqrt(np.partition(_distances(own[i:i + step], every), k, axis=1)[:, k])
                for f in full.as_py() or []:
                    bound = np.minimum(bound, to[:, f["p"]] + f["hi"])
                bound = bound * (1 + 1e-6) + 1e-6
                bands = [{"p": j, "from": float((to[:, j] - bound).min()), "to": float((to[:, j] + bound).max())} for j in range(used)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label.as_py()], label.type), pa.array([tile.as_py()]), pa.array([p.as_py()], pa.int32()),
                     _listed(keys.values.take(pa.array(mine))), pa.array([own.tobytes()], pa.binary()), _listed(pa.array(bound)),
                     pa.array([bands], pa.list_(pa.struct([("p", pa.int32()), ("from", pa.float64()), ("to", pa.float64())])))],
                    ["l", "tile", "p", "keys", "matrix", "bound", "bands"])

    return stored(rows.mapInArrow(reach, f"l {types[0]}, tile long, p int, keys {types[1]}, matrix binary, bound array<double>, "
                                         "bands array<struct<p:int,`from`:double,`to`:double>>"), "asking")


def _meetings(asking: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pairs of tiles (tile, other, q, lo, hi) whose rings a band touches, by a band join.

    Distances from a reference point are cut into as many bins as its class has tiles there; band and ring meet in the
    first bin that both have.
    """
    rings = tiles.select("l", "p", "lo", "hi", F.col("tile").alias("other"))
    scale = rings.groupBy(F.col("l").alias("_sl"), F.col("p").alias("_sp")).agg(F.max("hi").alias("top"), F.count("*").alias("bins"))
    scale = stored(scale, "scales")  # at most one row per class and reference point

    def binned(df: DataFrame, low: str, high: str) -> DataFrame:
        def at(x: Column) -> Column:
            share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(x, F.col("top"))))
            return F.floor(F.coalesce(share, F.lit(0.0)) * F.col("bins"))
        return (df.join(scale, F.col("l").eqNullSafe(F.col("_sl")) & (F.col("p") == F.col("_sp")))
                .withColumn("first", at(F.col(low))).withColumn("bin", F.explode(F.sequence("first", at(F.col(high)))))
                .drop("_sl", "_sp", "top", "bins"))

    bands = asking.select("l", "tile", F.inline("bands")).filter("`to` >= 0")
    a, b = binned(bands, "from", "to").alias("a"), binned(rings, "lo", "hi").alias("b")
    touch = (F.col("a.from") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.to"))
    once = F.col("a.bin") == F.greatest("a.first", "b.first")
    same = F.col("a.l").eqNullSafe(F.col("b.l")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.bin") == F.col("b.bin"))
    return a.join(b, same & touch & once).select("a.tile", "b.other", F.col("b.p").alias("q"), "b.lo", "b.hi")


def _visitors(asking: DataFrame, meetings: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Of each pair of tiles the rows (other, keys, matrix, bound) of the first that can have a neighbour in the other."""
    ktype = asking.schema["keys"].dataType.simpleString()
    pairs = asking.select("tile", "p", "keys", "matrix", "bound").join(stored(meetings, "meetings"), "tile").select(
        "other", "q", "lo", "hi", "p", "keys", "matrix", "bound")

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                other, q, lo, hi, p, keys, matrix, bound = (c[i] for c in batch.columns)
                reach = bound.values.to_numpy()
                own = _matrix(matrix, len(reach))
                p, q, lo, hi = p.as_py(), q.as_py(), lo.as_py(), hi.as_py()
                far = np.sqrt(_distances(own, pivots[[p, q]]))
                apart = np.sqrt(((pivots[p] - pivots[q]) ** 2).sum())
                may = (far[:, 1] - reach <= hi) & (far[:, 1] + reach >= lo)
                if apart > 0:  # the other cell lies beyond the plane half-way between the reference points
                    may &= (far[:, 1] ** 2 - far[:, 0] ** 2) / (2 * apart) <= reach
                if may.any():
                    take = pa.array(np.flatnonzero(may))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([other.as_py()]), _listed(keys.values.take(take)), pa.array([own[may].tobytes()], pa.binary()),
                         _listed(bound.values.take(take))], ["other", "keys", "matrix", "bound"])

    return pairs.mapInArrow(choose, f"other long, keys {ktype}, matrix binary, bound array<double>")


def class_neighbours(df: DataFrame, key: str, label: str, vector: str, wanted: Column, k: int = 5,
                     tile_rows: int = TILE_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """Exact ``k`` nearest rows of the same class for every row where ``wanted`` holds.

    Returns key, ``rank`` (1-based), ``neighbour`` and squared distance; ties go to the lower key. Rows without a
    vector take no part. Rows belong to the nearest of a few reference points (rows chosen by hash) and lie in tiles by
    their distance from it. The own tile, or a whole tile elsewhere, bounds how far the k-th neighbour is; by the
    triangle inequality only rows whose distance from a reference point lies in a band can be nearer, so a tile meets
    the tiles whose rings touch the band, and sends them only the rows that need them. ``tile_rows`` is the least size of
    a full tile; the tiles of a large class are larger, so that what travels grows with the rows and not with their pairs,
    and rows look at the stretch of a tile in their reach. What leaves a task are at most ``k`` rows within the bound for
    each row and tile.
    """
    base = df.select(F.col(key).alias("_k"), F.col(label).alias("_l"), F.col(vector).cast("array<double>").alias("_v"),
                     F.coalesce(wanted, F.lit(False)).alias("_w")).filter("_v IS NOT NULL")
    ktype = df.schema[key].dataType.simpleString()
    chosen = base.select("_v", portable_hash(F.col("_k").cast("string")).alias("h"), "_k").orderBy("h", "_k").limit(pivots).collect()
    points = np.array([r["_v"] for r in chosen] or [[0.0]], dtype="float64")  # a fixed number of rows
    tiles = _tiles(base, points, tile_rows)
    asking = _asking(tiles, points, k)
    visits = _visitors(asking, _meetings(asking, tiles), points)
    met = visits.join(tiles.select(F.col("tile").alias("other"), "p", F.col("keys").alias("others"), F.col("matrix").alias("vectors")), "other")

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, matrix, bound, p, others, vectors = (c[i] for c in batch.columns)
                mine, names, reach = keys.values, others.values, bound.values.to_numpy()
                # Rows of a tile rise by their distance from its reference point: some rows look at a stretch of it.
                own, every = _matrix(matrix, len(mine)), _matrix(vectors, len(names))
                far, ring = (np.sqrt(_distances(x, points[[p.as_py()]])[:, 0]) for x in (own, every))
                ids, other_ids = mine.to_numpy(zero_copy_only=False), names.to_numpy(zero_copy_only=False)
                by_key = other_ids.argsort(kind="stable").argsort(kind="stable")
                turn = np.argsort(far, kind="stable")
                for first in range(0, len(turn), LOOKING):
                    rows = turn[first:first + LOOKING]
                    low, high = (far[rows] - reach[rows]).min(), (far[rows] + reach[rows]).max()
                    inside = (np.searchsorted(ring, low), np.searchsorted(ring, high, "right")) if np.isfinite(high - low) else (0, len(names))
                    for row, col, d in _below(own[rows], every[slice(*inside)], reach[rows]):
                        row, col = rows[row], col + inside[0]
                        other = ids[row] != other_ids[col]
                        row, col, d = row[other], col[other], d[other]
                        best = _first(row, by_key[col], d, k)
                        if len(best):
                            yield pa.RecordBatch.from_arrays(
                                [mine.take(pa.array(row[best])), names.take(pa.array(col[best])), pa.array(d[best])], ["_k", "neighbour", "distance"])

    found = met.select("keys", "matrix", "bound", "p", "others", "vectors").mapInArrow(nearest, f"_k {ktype}, neighbour {ktype}, distance double")
    # The rank limit is applied before rows are shuffled to their key, too.
    rank = F.row_number().over(Window.partitionBy("_k").orderBy("distance", "neighbour"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select(F.col("_k").alias(key), "rank", "neighbour", "distance"))


def synthetic_rows(df: DataFrame, key: str, label: str, vector: str, k: int = 5, seed: int = 42,
                   tile_rows: int = TILE_ROWS) -> DataFrame:
    """The rows that lift every class to the size of the largest.

    Row j of a class starts from base row ``j mod count`` (in key order), moves a
    hashed share of the way to one of its ``k`` neighbours, chosen by another hash
    of (class, j). Returns label, ``j``, ``base``, ``neighbour`` and the vector.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0] or 0
    need = F.lit(largest) - F.col("_n")
    sized = dense_position(df.select(key, label, vector), [label], [key], "_pos")
    counts = stored(counts.withColumnRenamed(label, "_cl"), "class_counts")  # one row per class
    sized = sized.join(counts, F.col(label).eqNullSafe(F.col("_cl"))).drop("_cl").withColumn("_need", need)
    known = class_neighbours(sized, key, label, vector, F.col("_pos") < F.col("_need"), k,
                             tile_rows)
    choices = known.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("_c"))

    bases = sized.filter(F.col("_pos") < F.col("_need"))
    times = F.floor((F.col("_need") - F.col("_pos") - 1) / F.col("_n"))
    made = (bases.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), times)))
            .withColumn("j", F.col("_pos") + F.col("_i") * F.col("_n"))
            .join(choices, key, "left"))
    tag = F.concat_ws(":", F.col(label).cast("string"), F.col("j").cast("string"))
    pick = F.pmod(portable_hash(tag, seed), F.size("_c")).cast("int")
    # A class of one row has no neighbour: its copies stay where it is.
    made = made.withColumn("neighbour", F.coalesce(
        F.get(F.col("_c.neighbour"), pick), F.col(key))).withColumn(
        "_u", unit_interval(portable_hash(tag, seed + 1)))
    other = df.select(F.col(key).alias("neighbour"), F.col(vector).alias("_nv"))
    moved = F.zip_with(F.col(vector).cast("array<double>"), F.col("_nv").cast("array<double>"),
                       lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return (made.join(other, "neighbour")
            .withColumn("_m", moved)
            .select(label, "j", F.col(key).alias("base"), "neighbour",
                    F.transform("_m", lambda p: p.x + F.col("_u") * (p.y - p.x)).alias(vector)))


def oversample(df: DataFrame, key: str, label: str, vector: str, k: int = 5,
               seed: int = 42, **sizes) -> DataFrame:
    """Original rows plus synthetic ones; ``synthetic`` tells them apart."""
    old = df.select(key, label, F.col(vector).cast("array<double>").alias(vector),
                    F.lit(0).alias("synthetic"))
    new = synthetic_rows(df, key, label, vector, k, seed, **sizes).select(
        label, vector, F.lit(1).alias("synthetic"))
    return union_rows(old, new)


def two_stage_tables(df: DataFrame, label: str, single: str, rest: str) -> tuple[DataFrame, DataFrame]:
    """Tables of a two-stage problem: ``single`` against ``rest``, and the rest by class."""
    hit = F.col(label).eqNullSafe(F.lit(single))
    first = df.withColumn(label, F.when(hit, F.lit(single)).otherwise(F.lit(rest)))
    return first, df.filter(~hit)
