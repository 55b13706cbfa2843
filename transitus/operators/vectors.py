"""Exact cosine search over vectors partitioned by coarse centroids.

The index deals unit vectors over cells, each around a centre, and knows for each cell the largest angle between the
centre and a vector of it. A query at angle a to a centre of reach r finds nothing above cos(a - r) there. So each
query first searches the cells nearest to it, and then only those that can still hold one of its best. Nothing is
skipped that could be among them: the result is that of a full search.

Vectors and queries are tables of any size. Centres come from a bounded sample and, with one reach for each cell, are
all that the driver holds and tasks share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitus.functions.columns import n_rows
from transitus.session import stage

# At most so many cells, and sampled vectors for each of them: this bounds what the driver holds (dims x 8 bytes each).
MAX_CELLS, SAMPLE = 1_024, 32
ROUNDS = 6
# Cells that a query searches first, and rows of a cell's vectors and queries that meet in one step.
FIRST_CELLS, SLICE_ROWS, LOT_ROWS = 4, 8_192, 1_024
# Cosines are rounded to six places: a bound that close to the k-th best cannot be skipped.
SLACK = 2e-6


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def stacked(column: pd.Series) -> np.ndarray:
    return unit(np.stack([np.asarray(v, dtype=np.float64) for v in column]))


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by a few rounds of spherical k-means, started from the first sampled vectors that differ."""
    sample = np.unique(unit(sample), axis=0)
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)] if len(sample) else sample
    for _ in range(ROUNDS if len(centres) > 1 else 0):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        used = np.linalg.norm(sums, axis=1) > 0
        centres[used] = unit(sums[used])
    return centres


class VectorIndex:
    """`rows` (cell, slice, key, unit vector), written; `centres` and for each of them `reach`, its largest angle."""

    def __init__(self, rows: DataFrame, centres: np.ndarray, reach: np.ndarray, key: str) -> None:
        self.rows, self.centres, self.reach, self.key = rows, centres, reach, key


def build(vectors: DataFrame, key: str, vector: str = "embedding", cells: int | None = None) -> VectorIndex:
    """Index of `vectors`; rows with a null key or vector are left out.

    By default there are about as many cells as the square root of the vectors, up to `MAX_CELLS`. A cell with many
    vectors is cut into slices of about `SLICE_ROWS`, by a hash of the key.
    """
    spark = vectors.sparkSession
    usable = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("_v"))
    n = usable.count()
    cells = min(MAX_CELLS, cells or max(1, math.isqrt(n)))
    share = min(1.0, 2 * cells * SAMPLE / max(1, n))
    picked = usable.filter(F.pmod(F.xxhash64(F.lit("cells"), key), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = picked.select("_v").limit(cells * SAMPLE).collect()  # bounded by MAX_CELLS * SAMPLE
    centres = fitted(np.array([r["_v"] for r in sample], dtype=np.float64), cells) if sample else np.zeros((0, 1))
    held = spark.sparkContext.broadcast(centres)
    kinds = dict(usable.dtypes)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not frame.empty:
                own = stacked(frame["_v"])
                near = own @ held.value.T
                cell = near.argmax(axis=1)
                yield pd.DataFrame({
                    "_cell": cell.astype(np.int32), key: frame[key], "_v": list(own),
                    "_angle": np.arccos(np.clip(near[np.arange(len(own)), cell], -1, 1)),
                })

    dealt = stage(usable.mapInPandas(deal, f"_cell int, {key} {kinds[key]}, _v array<double>, _angle double"), "vector-cells")
    sizes = dealt.groupBy("_cell").agg(n_rows().alias("n"), F.max("_angle").alias("reach")).collect()  # a row per cell
    reach = np.full(len(centres), -np.inf)
    for r in sizes:
        reach[r["_cell"]] = r["reach"]
    slices = F.create_map(*[F.lit(x) for r in sizes for x in (r["_cell"], -(-r["n"] // SLICE_ROWS))]) if sizes else None
    cut = F.pmod(F.xxhash64(key), slices[F.col("_cell")]).cast("int") if sizes else F.lit(0)
    rows = stage(dealt.select("_cell", cut.alias("_slice"), key, "_v"), "vector-index")
    return VectorIndex(rows, centres, reach, key)


def _best(index: VectorIndex, asked: DataFrame, k: int, query_key: str, kinds: dict[str, str]) -> DataFrame:
    """(query, key, cosine): for each of `asked` (query, _q, _cell) the best `k` of that cell's slices."""
    key = index.key
    # a query goes to each slice of its cell, in lots: neither side of a step is larger than its bound
    slices = index.rows.select("_cell", "_slice").distinct()
    lots = asked.join(asked.groupBy("_cell").agg(F.ceil(n_rows() / LOT_ROWS).cast("bigint").alias("_lots")), "_cell")
    left = lots.join(slices, "_cell").select("_cell", "_slice", F.pmod(F.xxhash64(query_key), "_lots").cast("int").alias("_lot"), query_key, "_q")
    wanted = left.select("_cell", "_slice", "_lot").distinct()
    on = ["_cell", "_slice", "_lot"]
    # new names: Spark does not group two sides that share columns of one reading
    right = index.rows.join(wanted, ["_cell", "_slice"]).select(*[F.col(c).alias(f"_of{c}") for c in on], key, "_v")
    out = f"{query_key} {kinds[query_key]}, {key} {kinds['_key']}, cosine double"

    def meet(queries: pa.Table, held: pa.Table) -> pa.Table:
        dims = len(held.column("_v")[0]) if held.num_rows else 0
        flat = lambda t, c: pc.list_flatten(t.column(c)).to_numpy().reshape(t.num_rows, dims)
        if not held.num_rows or not queries.num_rows:
            return pa.table({query_key: queries.column(query_key).slice(0, 0), key: held.column(key).slice(0, 0), "cosine": pa.array([], pa.float64())})
        near = np.round(flat(queries, "_q") @ flat(held, "_v").T, 6)
        keys = held.column(key).combine_chunks()
        # equal values are ordered by key, as in the final ranking
        by_key = pc.sort_indices(keys).to_numpy()
        place = np.empty(len(by_key), dtype=np.int64)
        place[by_key] = np.arange(len(by_key))
        order = np.lexsort((np.broadcast_to(place, near.shape), -near), axis=1)[:, :k]
        return pa.table({
            query_key: queries.column(query_key).take(pa.array(np.repeat(np.arange(queries.num_rows), order.shape[1]))),
            key: keys.take(pa.array(order.ravel())), "cosine": pa.array(np.take_along_axis(near, order, axis=1).ravel()),
        })

    return left.groupBy(*on).cogroup(right.groupBy(*[f"_of{c}" for c in on])).applyInArrow(meet, out)


def search(index: VectorIndex, queries: DataFrame, k: int, query_key: str, vector: str = "embedding") -> DataFrame:
    """The `k` vectors of highest cosine per query, rounded to six places, equal ones by key: query, rank, key, cosine.

    Queries are a table of any size; `query_key` names a query. A null vector has no answers. A zero vector, and any
    vector against it, has cosine 0. Exact: a cell is left out only where the best it could hold lies below the k-th
    best found.
    """
    spark, key = index.rows.sparkSession, index.key
    held = spark.sparkContext.broadcast((index.centres, index.reach))
    kinds = {**dict(queries.dtypes), "_key": dict(index.rows.dtypes)[key]}
    asked = queries.filter(F.col(vector).isNotNull()).select(query_key, F.col(vector).cast("array<double>").alias("_q"))

    def bounds(own: np.ndarray) -> np.ndarray:
        """The highest cosine that each cell may hold for each query; zero vectors may sit in any cell."""
        centres, reach = held.value
        gap = np.arccos(np.clip(own @ centres.T, -1, 1)) - reach
        most = np.where(gap <= 0, 1.0, np.cos(np.clip(gap, 0, np.pi)))
        most[~own.any(axis=1)] = 0.0
        return np.where(np.isneginf(reach), -np.inf, most)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not frame.empty and len(held.value[0]):
                own = stacked(frame["_q"])
                most = bounds(own)
                order = np.argsort(-most, axis=1, kind="stable")[:, :FIRST_CELLS]
                yield pd.DataFrame({
                    query_key: frame[query_key].repeat(order.shape[1]).to_numpy(), "_q": [v for v in own for _ in range(order.shape[1])],
                    "_cell": order.ravel().astype(np.int32),
                })

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not frame.empty and len(held.value[0]):
                own = stacked(frame["_q"])
                most = bounds(own)
                first = np.argsort(-most, axis=1, kind="stable")[:, :FIRST_CELLS]
                open_ = most >= frame["_kth"].fillna(-np.inf).to_numpy()[:, None] - SLACK
                np.put_along_axis(open_, first, False, axis=1)
                open_ &= ~np.isneginf(most)
                row, cell = open_.nonzero()
                if not len(row):
                    continue
                yield pd.DataFrame({query_key: frame[query_key].to_numpy()[row], "_q": [own[r] for r in row], "_cell": cell.astype(np.int32)})

    shape = f"{query_key} {kinds[query_key]}, _q array<double>, _cell int"
    first = stage(_best(index, stage(asked.mapInPandas(probe, shape), "vector-probes"), k, query_key, kinds), "vector-first")
    best = Window.partitionBy(query_key).orderBy(F.desc("cosine"), key)
    ranked = first.withColumn("_at", F.row_number().over(best))
    kth = ranked.filter(F.col("_at") == k).select(query_key, F.col("cosine").alias("_kth"))
    more = stage(asked.join(kth, query_key, "left").mapInPandas(rest, shape), "vector-rest")
    found = first.unionByName(_best(index, more, k, query_key, kinds))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(query_key, "rank", key, "cosine")
