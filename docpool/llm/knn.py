"""The most similar vectors of every vector: block matrix join over int8 tiles with error bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpool.functions.ranks import salts_for, spread_join
from docpool.functions.storage import materialize

#: Rows of a cell that meet in one tile; larger cells are cut into blocks, each pair of which is a tile.
TILE = 512
#: Rows that a cell of the index is to hold on average.
CELL = 64
#: Tables of the index. Two vectors with cosine 0.95 share a cell of one table with probability 0.36 to 0.6.
TABLES = 14
#: Decimal places of the cosines that are ranked: scaled copies of a vector are ties, whatever their rounding.
DIGITS = 6
#: Rows that one task holds while queries stream past them, and rows and queries of one product.
GROUP_ROWS = 65_536
ROW_TILE, QUERY_TILE = 4096, 1024


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and norms of the residuals of unit vectors."""
    scale = np.abs(unit).max(1) / 127
    scale[scale == 0] = 1
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    residual = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, residual


def tile_bounds(qa: np.ndarray, sa: np.ndarray, ea: np.ndarray, qb: np.ndarray, sb: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximate cosines of a tile, and how far they may be off.

    The int8 products are summed in float32, exactly: 127 * 127 * dim stays below 2**24 up to 1,040 dimensions,
    and further blocks of dimensions are added in float64. u.v - a.b = (u - a).v + a.(v - b), so the error
    is at most ea + (1 + ea) * eb for unit vectors.
    """
    dims = qa.shape[1]
    product = sum((qa[:, i : i + 1024].astype(np.float32) @ qb[:, i : i + 1024].astype(np.float32).T).astype(np.float64) for i in range(0, dims, 1024))
    return product * (sa[:, None] * sb[None, :]), ea[:, None] + (1 + ea[:, None]) * eb[None, :] + 1e-6


def surviving(product: np.ndarray, error: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Mask of the pairs of a tile that may be among a row's k best: not below its k-th lower bound, nor below the floor."""
    upper, lower = product + error, product - error
    least = np.full(len(product), floor)
    if product.shape[1] > k:
        least = np.maximum(least, np.partition(lower, -k, axis=1)[:, -k])
    return upper >= least[:, None]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        x = x / np.abs(x).max(1, keepdims=True)  # no overflow at any scale
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rotations(dim: int, tables: int) -> np.ndarray:
    rng = np.random.default_rng(20240607)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(2 * tables)])


def _cells(unit: np.ndarray, rotations: np.ndarray, second: int) -> np.ndarray:
    """Cells by table: the nearest signed axis of one rotation, and of the first `second` axes of another."""
    out = []
    for t in range(0, len(rotations), 2):
        x = unit @ rotations[t]
        a = np.abs(x).argmax(1)
        cell = 2 * a + (x[np.arange(len(x)), a] > 0)
        if second:
            y = unit @ rotations[t + 1][:, :second]
            b = np.abs(y).argmax(1)
            cell = cell * (2 * second) + 2 * b + (y[np.arange(len(y)), b] > 0)
        out.append(cell * len(rotations) + t)
    return np.stack(out, 1)


def classes_of(rows: DataFrame, row_id: str, vector: str, dim: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, rep), and (rep, vector, firsts): rows whose directions are equal to five digits, with their first k + 1 ids.

    Rows with a null vector, another length, a null or not finite element, or only zeros are left out;
    of repeated ids one row counts.
    """
    read = rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    read = read.where(F.col("id").isNotNull() & (F.size("v") == dim) & finite & F.exists("v", lambda x: x != 0))

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(1), dim))
                keys = (np.rint(unit * 1e5) + 0.0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([blake2b(x.tobytes(), digest_size=16).digest() for x in keys], pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(unit.astype(np.float32).ravel()), dim).cast(pa.list_(pa.float32()))], names=["id", "direction", "vector"])

    unit = read.mapInArrow(directions, "id long, direction binary, vector array<float>")
    unit = materialize(unit, "directions").dropDuplicates(["id"])
    # at most k + 1 ids a class leave each part, so no hot class comes together whole
    part = Window.partitionBy("direction", "part").orderBy("id")
    parts = unit.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(salts_for(unit)))).withColumn("n", F.row_number().over(part)).where(F.col("n") <= k + 1)
    reps = parts.groupBy("direction").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("firsts"), F.min_by("vector", "id").alias("vector"))
    reps = materialize(reps.select(F.element_at("firsts", 1).alias("rep"), "direction", "vector", "firsts"), "vectors")
    members = spread_join(unit.select("id", "direction"), reps.select("direction", "rep"), "direction", "id").select("id", "rep")
    return members, reps.select("rep", "vector", "firsts")


def _coded(dim: int, tables: int, second: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations = _rotations(dim, tables)
        for batch in batches:
            if batch.num_rows:
                unit = _matrix(batch.column(1), dim)
                codes, scale, residual = quantised(unit)
                cells = _cells(unit, rotations, second)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), tables).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(scale.astype(np.float32)), pa.array(residual.astype(np.float32))], names=["rep", "cells", "codes", "scale", "residual"])

    return code


def _tiles(dim: int, k: int, floor: float):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for tile in batch.column(0):
                values = tile.values
                ids = values.field(0).to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(values.field(1).to_pylist()), np.int8).reshape(-1, dim)
                scale, residual = (values.field(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3))
                product, error = tile_bounds(codes, scale, residual, codes, scale, residual)
                np.fill_diagonal(product, -9.0)
                x, y = np.nonzero(surviving(product, error, k, floor))
                keep = ids[x] != ids[y]
                a.append(ids[x[keep]])
                b.append(ids[y[keep]])
            empty = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or empty)), pa.array(np.concatenate(b or empty))], names=["src", "dst"])

    return join


def _cosines(dim: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_unit(_matrix(batch.column(i), dim)) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x * y).sum(1))], names=["src", "dst", "cosine"])

    return score


def _merged(k: int):
    """Reads pairs sorted by src and gives the k best of each, by a heap of (cosine, -dst)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        heap: list[tuple[float, int]] = []
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for src, dst, cosine in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if src != current:
                    out.extend((current, -j, c) for c, j in heap)
                    current, heap = src, []
                if len(heap) < k:
                    heapq.heappush(heap, (cosine, -dst))
                elif (cosine, -dst) > heap[0]:
                    heapq.heapreplace(heap, (cosine, -dst))
            yield _pairs(out)
        yield _pairs([(current, -j, c) for c, j in heap])

    return merge


def _pairs(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["src", "dst", "cosine"])


def neighbours_above(rows: DataFrame, row_id: str, vector: str, *, dim: int, k: int = 5, floor: float = 0.95, tables: int = TABLES, cell: int = CELL, tile: int = TILE) -> DataFrame:
    """(id, neighbour, cosine, place): of every vector the k most similar ones with cosine `floor` or more, ties by id.

    An index of cross-polytope cells (random rotations, fitted to nothing but the number of vectors) says which
    rows meet: those of a cell, in `tables` tables. A cell's tile of int8 products, with bounds of the
    quantisation error, leaves the pairs that can be among the k best; their cosines are computed from the
    float vectors and merged by heaps. The number of cells grows with the vectors, so the work per vector stays.
    A pair at cosine 0.95 escapes all 14 tables with a probability of 0.002 at most, closer pairs hardly ever.

    Rows without a usable vector (null, of another length, with null or not finite elements, all zero) are
    left out; scale does not matter. Rows of one direction meet as one, with their first k + 1 ids, which
    is all that k places can show; a cell of more than `tile` vectors is cut into tiles for several tasks.
    No rows give no rows.
    """
    members, reps = classes_of(rows, row_id, vector, dim, k)
    members = materialize(members, "members")
    n = reps.count()
    second = min(dim, max(0, round(n / cell / (2 * dim) / 2)))
    coded = reps.select("rep", "vector").mapInArrow(_coded(dim, tables, second), "rep long, cells array<long>, codes binary, scale float, residual float")
    coded = materialize(coded, "codes")
    placed = coded.select(F.explode("cells").alias("cell"), F.struct("rep", "codes", "scale", "residual").alias("m"))
    hot = coded.select(F.explode("cells").alias("hot")).groupBy("hot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("hot", F.ceil(F.col("n") / (tile / 2)).cast("int").alias("blocks"))
    placed = placed.join(hot, F.col("cell") == F.col("hot"), "left").withColumn("block", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("m.rep"), F.col("blocks"))).otherwise(0).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    lists = placed.groupBy("cell", F.least("block", "other").alias("t1"), F.greatest("block", "other").alias("t2")).agg(F.collect_list("m").alias("l")).where(F.size("l") > 1)
    pairs = lists.select("l").mapInArrow(_tiles(dim, k, floor), "src long, dst long").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    v = reps.select("rep", "vector")
    joined = pairs.join(v.select(F.col("rep").alias("src"), F.col("vector").alias("x")), "src").join(v.select(F.col("rep").alias("dst"), F.col("vector").alias("y")), "dst")
    scored = joined.select("src", "dst", "x", "y").mapInArrow(_cosines(dim), "src long, dst long, cosine double").where(F.col("cosine") >= floor).withColumn("cosine", F.round("cosine", DIGITS))
    scored = materialize(scored, "cosines")
    both = scored.unionByName(scored.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cosine"))
    near = both.repartition("src").sortWithinPartitions("src").mapInArrow(_merged(k), "src long, dst long, cosine double")
    near = near.unionByName(reps.where(F.size("firsts") > 1).select(F.col("rep").alias("src"), F.col("rep").alias("dst"), F.lit(1.0).alias("cosine")))
    shown = near.join(reps.select(F.col("rep").alias("dst"), "firsts"), "dst").select("src", "cosine", F.explode("firsts").alias("neighbour"))
    row = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    found = spread_join(members.select("id", F.col("rep").alias("src")), shown, "src", "id").where(F.col("id") != F.col("neighbour"))
    return found.withColumn("place", F.row_number().over(row)).where(F.col("place") <= k).select("id", "neighbour", "cosine", "place")


class _Best:
    """The k best rows of each query so far, as heaps of (cosine, -id)."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -2.0)  # the k-th best cosine

    def take(self, x: np.ndarray, other: np.ndarray, cosines: np.ndarray) -> None:
        """Adds pairs (place of the query, id of the row); of a query's pairs only the k best are put on its heap."""
        own = other == self.ids[x]
        x, other, cosines = x[~own], other[~own], cosines[~own]
        order = np.lexsort((other, -cosines, x))
        x, other, cosines = x[order], other[order], cosines[order]
        first = np.searchsorted(x, x, "left")
        few = np.arange(len(x)) - first < self.k
        for i, j, c in zip(x[few].tolist(), other[few].tolist(), cosines[few].tolist(), strict=True):
            heap, item = self.heaps[i], (c, -j)
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def batch(self) -> pa.RecordBatch:
        out = [(int(i), -j, c) for i, heap in zip(self.ids, self.heaps, strict=True) for c, j in heap]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["id", "neighbour", "cosine"])


def _grid(dim: int, k: int):
    """Reads rows (grp, asked, id, v) sorted by grp and asked: holds a group's rows, and gives the k best of them for each query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, tiles = None, [], None
        for batch in batches:
            grp, asked, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.nonzero((np.diff(grp) != 0) | (np.diff(asked) != 0))[0] + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == stop:
                    continue
                unit = _matrix(batch.column(3).slice(start, stop - start), dim)
                if grp[start] != group:
                    group, parts, tiles = grp[start], [], None
                if not asked[start]:
                    parts.append((ids[start:stop], unit))
                    continue
                if tiles is None:  # the group's rows are all there
                    whole = (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros((0, dim)))
                    tiles = [(whole[0][i : i + ROW_TILE], whole[1][i : i + ROW_TILE], *quantised(whole[1][i : i + ROW_TILE])) for i in range(0, len(whole[0]), ROW_TILE)]
                    parts = []
                for at in range(start, stop, QUERY_TILE):
                    end = min(stop, at + QUERY_TILE)
                    queries = unit[at - start : end - start]
                    qa, sa, ea = quantised(queries)
                    best = _Best(ids[at:end], k)
                    for other, rows, qb, sb, eb in tiles:
                        product, error = tile_bounds(qa, sa, ea, qb, sb, eb)
                        mask = surviving(product, error + 10.0**-DIGITS, k + 1, -2.0) & (product + error >= best.least[:, None] - 10.0**-DIGITS)
                        x, y = np.nonzero(mask)
                        best.take(x, other[y], np.round(np.einsum("ij,ij->i", queries[x], rows[y]), DIGITS))
                    yield best.batch()

    return scan


def nearest(rows: DataFrame, row_id: str, vector: str, queries: DataFrame, *, dim: int, k: int = 5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, neighbour, cosine, place): of each query vector the k most similar rows, exactly, ties by id.

    queries holds rows of the same columns; a row is no neighbour of itself. Rows are dealt out to groups of about
    group_rows, each held by one task, past which the queries stream; per query and group the k best rows go
    on, and are merged. Rows move once and queries once for each group, nothing through the driver, and no task
    holds more than a group and a batch of queries. Unusable vectors, on either side, are left out as in
    neighbours_above; of repeated ids one row counts. No rows or no queries give no rows.
    """

    def usable(df: DataFrame) -> DataFrame:
        read = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return read.where(F.col("id").isNotNull() & (F.size("v") == dim) & finite & F.exists("v", lambda x: x != 0))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(1), dim)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), dim).cast(pa.list_(pa.float64()))], names=["id", "v"])

    one = usable(rows)
    sizes = one.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("ids"), F.max("n").alias("most")).first()
    if (sizes["most"] or 0) > 1:
        one = one.dropDuplicates(["id"])  # copies would fill the heaps; without any, no vector moves for it
    groups = max(1, -(-sizes["ids"] // group_rows))
    every = one.mapInArrow(normal, "id long, v array<double>").select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp"), F.lit(False).alias("asked"), "id", "v")
    asked = usable(queries).dropDuplicates(["id"]).mapInArrow(normal, "id long, v array<double>").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(True).alias("asked"), "id", "v")
    met = every.unionByName(asked).repartition(groups, "grp").sortWithinPartitions("grp", "asked")
    found = met.mapInArrow(_grid(dim, k), "id long, neighbour long, cosine double")
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
