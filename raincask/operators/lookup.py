"""Lookups with defaults, nearest points, analogues."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import stored


#: Rows of a table that a task may be sent whole.
BROADCAST_ROWS = 10_000


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, default) -> DataFrame:
    """Left join with a default where the table has no row."""
    return df.join(table.select(*keys, value), list(keys), "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def fallback_lookup(df: DataFrame, table: DataFrame, exact: Sequence[str], wide: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values of the row for all keys, else of the row whose other keys are null."""
    narrow = [k for k in exact if k not in wide]
    table, _ = stored(table.select(*exact, *values), "lookup")
    some = table.where(F.col(narrow[0]).isNotNull()).select(*exact, *(F.col(v).alias(f"_e_{v}") for v in values))
    whole = table.where(F.col(narrow[0]).isNull()).select(*wide, *(F.col(v).alias(f"_w_{v}") for v in values))
    # A table of few rows goes to all tasks: joined by its keys, all rows of a key would lie in one.
    near = F.broadcast if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda t: t
    out = df.join(near(some), list(exact), "left").join(near(whole), list(wide), "left")
    return out.select(*df.columns, *(F.coalesce(f"_e_{v}", f"_w_{v}").alias(v) for v in values))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


#: Archive rows and queries of a block, on average in the largest stratum, and numbers of a table of distances.
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_CELLS = 16_384, 8_192, 1 << 22
#: Boxes of lines for each block of rows.
BLOCK_BOXES = 8


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A line for each vector, and which components are there; null or missing ones are 0."""
    rows = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    size = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten()
    there = np.arange(size.max(initial=0)) < size[:, None]
    out = np.zeros(there.shape)
    out[there] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    there[there] = flat.is_valid().to_numpy(zero_copy_only=False)
    return out, there


def nearest_pairs(q: np.ndarray, a: np.ndarray, need: np.ndarray, tie: np.ndarray, weight: np.ndarray | None = None, own: tuple[np.ndarray, np.ndarray] | None = None, there: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line of q, line of a, distance, whether it has one) of the lines of a nearest to each line of q, in order.

    need: rows wanted for each line of q; a line of a counts for `weight` rows; equal distances go by
    `tie`; own: ids of q and a, of which equal ones don't meet. A matrix product bounds all distances and
    leaves few pairs, whose squares are then added up component by component, as `squared_distance` does.
    Components that either side lacks are left out; without any there is no distance, which comes last.
    """
    width = min(q.shape[1], a.shape[1])
    full = [np.ones(x.shape, bool) for x in (q, a)] if there is None else there
    short = [q.shape[1] > width or not full[0].all(), a.shape[1] > width or not full[1].all()]
    with np.errstate(over="ignore", invalid="ignore"):
        norms = [(x * x).sum(axis=1) for x in (q, a)]
    # Lines that lack components or could overflow skip the bound.
    odd = [~((n < 1e200) & f[:, :width].all(axis=1) & (f.sum(axis=1) == width)) for n, f in zip(norms, full)]
    plain = [np.where(o[:, None], 0.0, x[:, :width]) for o, x in zip(odd, (q, a))]
    norms = [np.where(o, 0.0, n) for o, n in zip(odd, norms)]
    step, found = max(1, BLOCK_CELLS // max(1, len(a))), []
    for first in range(0, len(q) if len(a) else 0, step):
        s = slice(first, first + step)
        bound = norms[0][s, None] + norms[1] - 2.0 * (plain[0][s] @ plain[1].T)
        met = np.ones(bound.shape, bool) if own is None else np.asarray(own[0][s, None] != own[1][None, :])
        loose = odd[0][s, None] | odd[1]
        bound[loose | ~met] = np.inf
        most = int(need[s].max())
        if most < len(a):
            edge = np.partition(bound, most - 1, axis=1)[:, most - 1] + 1e-9 * (norms[0][s] + norms[1].max())
            met &= (bound <= edge[:, None]) | loose
        i, j = np.nonzero(met)
        i += first
        squared, any_there = np.zeros(len(i)), np.zeros(len(i), bool)
        with np.errstate(over="ignore", invalid="ignore"):
            for c in range(width):
                x = q[i, c] - a[j, c]
                if any(short):
                    both = full[0][i, c] & full[1][j, c]
                    x, any_there = np.where(both, x, 0.0), any_there | both
                squared += x * x
        distance = np.sqrt(squared)
        known = any_there if any(short) else np.full(len(i), width > 0)
        order = np.lexsort((tie[j], distance, ~known, i))
        i, j, distance, known = i[order], j[order], distance[order], known[order]
        start = np.concatenate([[True], i[1:] != i[:-1]])[: len(i)]
        rows = np.ones(len(i), np.int64) if weight is None else weight[j]
        before = np.cumsum(rows) - rows
        keep = before - np.maximum.accumulate(np.where(start, before, 0)) < need[i]
        found.append((i[keep], j[keep], distance[keep], known[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))


def _largest(df: DataFrame, by: Sequence[str]) -> int:
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def nearest(queries: DataFrame, archive: DataFrame, by: Sequence[str], qid: str, aid: str, vector: str, k: int) -> DataFrame:
    """The k archive rows nearest to each query within its stratum, itself excepted; ties by id, rows without a distance last.

    A stated query set against all rows of its stratum, exactly: blocks of rows meet blocks of queries
    once each, in a task of its own, and give k rows a query at most.
    """
    by = list(by)
    there = lambda df, *columns: df.na.drop(subset=list(columns))
    q = there(queries.select(*by, F.col(qid).alias("query"), F.col(vector).cast("array<double>").alias("_q")), *by, "query")
    a = there(archive.select(*by, F.col(aid).alias("neighbour"), F.col(vector).cast("array<double>").alias("_a")), *by, "neighbour")
    rows, asked = (max(1, math.ceil(_largest(df, by) / most)) for df, most in ((a, BLOCK_ROWS), (q, BLOCK_QUERIES)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    a = a.withColumn("_ab", place(rows, "neighbour", "_a")).withColumn("_qb", each(asked))
    q = q.withColumn("_qb", place(asked, "query", "_q")).withColumn("_ab", each(rows))
    keys = [*by, "_ab", "_qb"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (x, x_there), (y, y_there) = _vectors(left["_q"]), _vectors(right["_a"])
        ids = left["query"].to_numpy(), right["neighbour"].to_numpy()
        tie = np.empty(len(ids[1]), np.int64)
        tie[np.argsort(ids[1], kind="stable")] = np.arange(len(tie))
        i, j, distance, known = nearest_pairs(x, y, np.full(len(x), k), tie, own=ids, there=(x_there, y_there))
        one = left.take(i)
        return pa.table({**{c: one[c] for c in (*by, "query")}, "neighbour": right["neighbour"].take(j), "distance": pa.array(distance, pa.float64(), mask=~known)})

    schema = T.StructType([*(q.schema[c] for c in (*by, "query")), a.schema["neighbour"], T.StructField("distance", T.DoubleType())])
    local = q.groupBy(*keys).cogroup(a.groupBy(*keys)).applyInArrow(run, schema)
    w = Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), "neighbour")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_lines(queries: DataFrame, lines: DataFrame, by: Sequence[str], vector: str, need: str, weight: str) -> DataFrame:
    """(by, vector, distance, weight): `nearest_lists` with a row for each query and line."""
    return nearest_lists(queries, lines, by, vector, need, weight).select(*by, vector, F.inline("_near")).withColumnRenamed("_n", weight)


def nearest_lists(queries: DataFrame, lines: DataFrame, by: Sequence[str], vector: str, need: str, weight: str) -> DataFrame:
    """(by, vector, _near: array of (distance, _n)): for each query vector of few dimensions, the nearest lines that together stand for `need` rows, a list from each box.

    queries: (by, vector, need), lines: (by, vector, weight), a line for each distinct vector, whose
    weight says how many rows it stands for. Cuts at approximate quantiles make boxes of lines. A query
    meets the lines of its own box first; what it finds there is as far as it has to look, so that it
    then meets the boxes within that distance alone.
    """
    by, size = list(by), lines.select(F.max(F.size(vector))).first()[0] or 0
    cells = max(1, math.ceil(_largest(lines, by) * BLOCK_BOXES / BLOCK_ROWS))
    sides = max(1, math.ceil(cells ** (1 / max(size, 1))))
    share = F.array(*(F.lit(i / sides) for i in range(1, sides)))
    cuts = list(lines.select(*(F.percentile_approx(F.col(vector)[c], share, 1000) for c in range(size))).first()) if sides > 1 else []
    reached = lambda c: lambda x: x <= F.col(vector)[c]
    spot = sum((F.size(F.filter(F.array(*map(F.lit, sorted(set(cut)))), reached(c))) * sides**c for c, cut in enumerate(cuts)), F.lit(0))
    placed = lines.select(*by, F.col(vector).alias("_a"), F.col(weight).cast("long").alias("_n"), spot.cast("long").alias("_box"))
    asked = queries.select(*by, F.col(vector).alias("_q"), F.col(need).cast("long").alias("_need"), spot.cast("long").alias("_box")).withColumn("_far", F.lit(float("inf")))
    boxes = placed.groupBy(*by, "_box").agg(F.count("*").alias("_lines"), *(end(F.col("_a")[c]).alias(f"{name}{c}") for c in range(size) for name, end in (("_low", F.min), ("_high", F.max))))
    keys = [*by, "_box", "_qb"]

    def meet(asked: DataFrame, farthest: bool) -> DataFrame:
        blocks = max(1, math.ceil(_largest(asked, [*by, "_box"]) / BLOCK_QUERIES))
        split = asked.withColumn("_qb", F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int"))
        every = placed.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            (x, _), (y, _) = _vectors(left["_q"]), _vectors(right["_a"])
            need, n = left["_need"].to_numpy(), right["_n"].to_numpy()
            i, j, distance, _ = nearest_pairs(x, y, need, np.arange(len(y)), n)
            if farthest:
                far = np.full(len(x), np.inf)
                held = np.bincount(i, weights=n[j], minlength=len(x)) >= need if len(i) else np.zeros(len(x), bool)
                last = np.full(len(x), -np.inf)
                np.maximum.at(last, i, distance)
                far[held] = last[held]
                one = left.select([*by, "_q", "_need"])
                return one.append_column("_far", pa.array(far, pa.float64()))
            near = distance <= left["_far"].to_numpy()[i]
            i, j, distance = i[near], j[near], distance[near]
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])[: len(i)])
            one = left.take(i[first])
            each = pa.StructArray.from_arrays([pa.array(distance, pa.float64()), pa.array(n[j], pa.int64())], ["distance", "_n"])
            return pa.table({**{c: one[c] for c in (*by, "_q")}, "_near": pa.ListArray.from_arrays(pa.array([*first, len(i)], pa.int32()), each)})

        fields = [split.schema[c] for c in (*by, "_q")]
        more = [T.StructField("_need", T.LongType()), T.StructField("_far", T.DoubleType())] if farthest else [T.StructField("_near", T.ArrayType(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("_n", T.LongType())])))]
        return split.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(run, T.StructType([*fields, *more]))

    beyond = [F.greatest(F.col(f"_low{c}") - F.col("_q")[c], F.col("_q")[c] - F.col(f"_high{c}"), F.lit(0.0)) for c in range(size)]
    gap = sum((x * x for x in beyond), F.lit(0.0))
    bounded, _ = stored(meet(asked, True), "nearest")
    # A margin for the last bits, in which a bound may differ from a distance.
    boxes = boxes.select(*(F.col(c).alias(c) for c in boxes.columns))  # columns of their own, as lines are met again
    again = bounded.join(F.broadcast(boxes) if boxes.count() <= BLOCK_ROWS else boxes, by).where(F.sqrt(gap) <= F.col("_far") * (1 + 1e-9)).select(*by, "_q", "_need", "_far", "_box")
    again, _ = stored(again, "boxes")
    return meet(again, False).select(*by, F.col("_q").alias(vector), "_near")
