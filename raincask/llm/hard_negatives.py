"""Hard negatives by exact search behind a PCA rotation.

Vectors are rounded to integers, and a score is an integer inner product. An orthogonal rotation by the
principal axes keeps inner products and moves most of each vector's length into few leading components.
The product over the leading components differs from the whole by at most the product of the two
residual lengths, plus slack for rounding; pairs whose upper bound is below what is already certain are
given up, after a few components and again after more. What survives gets its integer product.

Rows are dealt to blocks by a hash of their id, whatever their labels, and each block of rows meets
each block of queries once: queries travel once for each block of rows, the rows themselves once. A
task holds one block of each and bounds for SUB queries by STEP rows. The driver sees one
second-moment matrix of the vectors' dimension, and counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, ragged, rows_per_batch

#: Rows in a block, at most and at least; queries in a block; queries by rows whose bounds are held at a time.
ROWS, LEAST_ROWS, QUERIES = 65_536, 1024, 2048
SUB, STEP = 64, 4096
#: Shares of all vectors' squared length that leading components hold when bounds are tested.
STAGES = (0.5, 0.85)
#: Rounding slack, relative to the product of the lengths; the true error of a double product is some 1e-13 of it.
SLACK = 1e-9
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> tuple[DataFrame, int]:
    """(vec_id, label, q), one row for each id that takes part, and the dimension; see `hard_negatives`."""
    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).dropna()
    finite = whole.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    counts = finite.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = counts["d"] if counts else 0
    # Sums of d products of such numbers fit a long.
    most = math.isqrt((1 << 62) // max(d, 1))
    good = finite.where((F.size("v") == d) & F.forall("v", lambda x: F.abs(x) < most / scale))
    one = good.groupBy("vec_id").agg(F.min(F.struct("label", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q"))).alias("r"))
    return one.select("vec_id", "r.label", "r.q"), d


def pack_blocks(rows: DataFrame, blocks: int, numbers: list[str]) -> DataFrame:
    """Rows as one row a block: its number, and byte strings of the long columns `numbers` and of the vectors q."""
    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        out = {"block": pa.array([table.column("block")[0].as_py()], pa.int64())}
        for c in numbers:
            out[c] = pa.array([table.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary())
        q = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        narrow = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not q.size or np.iinfo(t).min <= q.min() and q.max() <= np.iinfo(t).max)
        out["width"] = pa.array([np.dtype(narrow).itemsize], pa.int32())
        out["q"] = pa.array([q.astype(narrow).tobytes()], pa.binary())
        return pa.table(out)

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(pack, f"block long, {', '.join(f'{c} binary' for c in numbers)}, width int, q binary")


def _vectors(raw: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").reshape(n, -1).astype(np.int64)


def second_moment(blocks: DataFrame, d: int) -> np.ndarray:
    """Sum of q q^T over all rows, in parts by task, then by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for raw, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q = np.frombuffer(raw, f"<i{width}").reshape(-1, d).astype(np.float64)
                total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "line"])

    lines = blocks.select("q", "width").mapInArrow(run, "i int, line array<double>").select("i", F.posexplode("line").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # d x d numbers
    out = np.zeros((d, d))
    for r in lines:
        out[r["i"], r["j"]] = r["x"]
    return out


def rotation(moment: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Orthonormal columns, the axis of the largest moment first, and after how many of them bounds are tested.

    Any orthonormal columns and any numbers give right results; these prune well.
    """
    sizes, axes = np.linalg.eigh(moment)
    share = np.cumsum(np.maximum(sizes[::-1], 0))
    return np.linalg.qr(axes[:, ::-1])[0], sorted({int(np.searchsorted(share, s * share[-1])) + 1 for s in STAGES if share[-1] > 0} | {1})[-len(STAGES) :]


class Rotated:
    """Integer vectors, rotated, with their lengths and what is left of them after each test."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray, cuts: list[int]):
        self.q, self.y, self.cuts = vectors, vectors.astype(np.float64) @ axes, cuts
        self.length = np.sqrt(np.einsum("ij,ij->i", self.y, self.y))
        self.rest = [np.sqrt(np.einsum("ij,ij->i", self.y[:, c:], self.y[:, c:])) for c in cuts]

    def part(self, rows) -> Rotated:
        out = object.__new__(Rotated)
        out.q, out.y, out.cuts, out.length, out.rest = self.q[rows], self.y[rows], self.cuts, self.length[rows], [r[rows] for r in self.rest]
        return out


def _best(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each anchor: by score, high first, then by id."""
    order = np.lexsort((ids, -score, anchor))
    a = anchor[order]
    first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0)) if len(a) else np.zeros(0, np.int64)
    return order[np.arange(len(a)) - start < k]


def survivors(a: Rotated, r: Rotated, allowed: np.ndarray | None, floor: np.ndarray, ceiling: np.ndarray | None, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) whose score counts, with that integer score.

    A pair stays while its upper bound reaches the anchor's floor and its lower bound the ceiling. With
    k, what can't be among an anchor's k best goes too: those whose upper bound is under the k-th largest
    lower bound. After the first test, sums go on for all pairs or, once few are left, for those alone.
    """
    slack = SLACK * a.length * r.length.max(initial=0.0) + 1e-6
    keep = np.ones((len(a.q), len(r.q)), bool) if allowed is None else allowed
    partial, pairs, done = np.zeros(keep.shape), None, 0
    for cut, a_rest, r_rest in zip(a.cuts, a.rest, r.rest):
        if pairs is None:
            partial += a.y[:, done:cut] @ r.y[:, done:cut].T
            rest = np.outer(a_rest, r_rest)
            rest += slack[:, None]
            high, low = partial + rest, None
            keep = keep & (high >= floor[:, None])
            if ceiling is not None:
                keep &= partial - rest <= ceiling[:, None]
            if k is not None and high.shape[1] > k:
                low = np.where(keep, partial - rest, -np.inf)
                keep &= high >= np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k][:, None]
            if np.count_nonzero(keep) * 8 < keep.size:
                pairs = np.nonzero(keep)
                partial = partial[pairs]
        else:
            i, j = pairs
            partial = partial + _products(a.y[:, done:cut], r.y[:, done:cut], i, j)
            rest = a_rest[i] * r_rest[j] + slack[i]
            good = partial + rest >= floor[i]
            if ceiling is not None:
                good &= partial - rest <= ceiling[i]
            pairs, partial = (i[good], j[good]), partial[good]
        done = cut
    i, j = pairs if pairs is not None else np.nonzero(keep)
    return i, j, _products(a.q, r.q, i, j)


def _products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of x with the rows j of y, a bounded number at a time."""
    out = np.empty(len(i), x.dtype)
    for at in range(0, len(i), 1 << 15):
        s = slice(at, at + (1 << 15))
        out[s] = np.einsum("ij,ij->i", x[i[s]], y[j[s]])
    return out


def _search_block(numbers: dict[str, np.ndarray], a: Rotated, ids: np.ndarray, labels: np.ndarray, r: Rotated, k: int, same: bool) -> list[np.ndarray]:
    """The k best rows of one block for each query of another: query, other id, score. Queries of one anchor share its bounds."""
    out = [[], [], []]
    # Rows lie by label, queries by label and anchor, so that one label's rows or all others' are ranges.
    order = np.lexsort((numbers["query"], numbers["vec_id"], numbers["label"]))
    first = np.flatnonzero(np.r_[True, np.diff(numbers["vec_id"][order]) != 0])
    count = np.diff(np.r_[first, len(order)])
    for label in np.unique(numbers["label"]):
        of_label = np.flatnonzero(numbers["label"][order[first]] == label)
        mine = np.searchsorted(labels, [label, label + 1])
        spans = [tuple(mine)] if same else [(0, mine[0]), (mine[1], len(ids))]
        for at in range(0, len(of_label), SUB):
            anchors = of_label[at : at + SUB]
            vector = order[first[anchors]]
            queries = order[ragged(first[anchors], count[anchors])]
            starts = np.cumsum(count[anchors]) - count[anchors]
            low, high = numbers["low"][queries].copy(), numbers["high"][queries]
            top, own = np.maximum.reduceat(high, starts), numbers["vec_id"][vector]
            best = [np.zeros(0, np.int64)] * 3
            part_a = a.part(vector)
            for begin, end in spans:
                for start in range(begin, end, STEP):
                    part = slice(start, min(end, start + STEP))
                    allowed = own[:, None] != ids[part][None, :] if same else None
                    floor = np.minimum.reduceat(low, starts)
                    i, j, score = survivors(part_a, r.part(part), allowed, floor, None if same else top, k if same else None)
                    # Each pair of anchor and row, once for each query of the anchor.
                    each = ragged(starts[i], count[anchors][i])
                    j, score = np.repeat(j, count[anchors][i]), np.repeat(score, count[anchors][i])
                    good = (score >= low[each]) & (score <= high[each])
                    best = [np.concatenate(x) for x in zip(best, (each[good], ids[part][j[good]], score[good]))]
                    keep = _best(best[0], best[2], best[1], k)
                    best = [x[keep] for x in best]
                    full = np.bincount(best[0], minlength=len(low)) >= k
                    least = np.full(len(low), HIGHEST)
                    np.minimum.at(least, best[0], best[2])
                    low = np.where(full, np.maximum(low, least), low)
            for held, x in zip(out, (numbers["query"][queries][best[0]], best[1], best[2])):
                held.append(x)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def search(queries: DataFrame, rows: DataFrame, blocks: int, axes: tuple[np.ndarray, list[int]], k: int, same: bool, tasks: int) -> DataFrame:
    """(query, other_id, score): for each query the k best rows of each block of rows, by score, then by id.

    queries: blocks of (query, vec_id, label, low, high, q), low and high being the scores that count;
    rows: `blocks` blocks of (vec_id, label, q). `same` asks for rows of the query's label, else for
    others'; rows with the query's own id never count.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for batch in batches:
            for x in batch.to_pylist():
                if x["r_block"] != block:
                    ids, labels = (np.frombuffer(x[c], np.int64) for c in ("r_vec_id", "r_label"))
                    order = np.argsort(labels, kind="stable")
                    block, held = x["r_block"], (ids[order], labels[order], Rotated(_vectors(x["r_q"], x["r_width"], len(ids))[order], *axes))
                numbers = {c: np.frombuffer(x[c], np.int64) for c in ("query", "vec_id", "label", "low", "high")}
                found = _search_block(numbers, Rotated(_vectors(x["q"], x["width"], len(numbers["query"])), *axes), *held, k, same)
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], ["query", "other_id", "score"])

    beside = rows.select(F.col("block").alias("r_block"), *(F.col(c).alias(f"r_{c}") for c in ("vec_id", "label", "width", "q"))).repartition(tasks, "r_block")
    sent = queries.drop("block").withColumn("r_block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))).repartition(tasks, "r_block")
    with rows_per_batch(rows.sparkSession, 2):
        return materialise(sent.hint("merge").join(beside, "r_block").mapInArrow(run, "query long, other_id long, score long"), "block-best")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, margin: tuple[int, int] = (4, 5), scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hardest negatives that are no likely positives.

    Anchors are the rows whose id is divisible by `every`. Scores are inner products of components
    floor(scale * x). A positive is one of the best `positives` other rows of the anchor's label; its
    negatives are the best `negatives` rows of other labels that score at most as high as it and at
    least margin[0] / margin[1] of it. Best is by score, then by smaller id. Pairs without a negative
    give no rows.

    Rows with a null id, label or vector, or with a null, NaN or infinite component take no part, nor do
    vectors of another length than most have (of equally many, the longer), nor those whose products
    could pass a long (components of 2^20 or more at 64 dimensions). Of rows that repeat an id, the one
    with the least label, then the least vector takes part. Other columns are ignored; an empty table
    gives no rows.
    """
    spark = rows.sparkSession
    whole, d = integer_vectors(rows, id_col, vector_col, label_col, scale)
    whole = materialise(whole, "integer-vectors")
    count, anchors = whole.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    if not anchors or not d:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = math.ceil(count / max(LEAST_ROWS, min(ROWS, math.ceil(count / (2 * parallel)))))
    tasks = max(1, min(blocks, 8 * parallel))
    packed = materialise(pack_blocks(whole, blocks, ["vec_id", "label"]), "row-blocks")
    axes = rotation(second_moment(packed, d))
    mine = whole.where(F.col("vec_id") % every == 0)

    def query_blocks(table: DataFrame, n: int) -> DataFrame:
        return materialise(pack_blocks(table, math.ceil(max(n, 1) / QUERIES), ["query", "vec_id", "label", "low", "high"]), "query-blocks")

    first = query_blocks(mine.select(F.col("vec_id").alias("query"), "vec_id", "label", F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"), "q"), anchors)
    near = search(first, packed, blocks, axes, positives, True, tasks)
    chosen = materialise(_ranked(near, ["query"], positives).select(F.col("query").alias("anchor_id"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    # A query for each positive: an anchor's id and the positive's rank are its number.
    low = F.expr(f"positive_score - positive_score div {margin[1]} * {margin[1] - margin[0]} - (pmod(positive_score, {margin[1]}) * {margin[1] - margin[0]}) div {margin[1]}")
    asked = chosen.where("positive_score >= 0").withColumn("query", F.xxhash64("anchor_id", "rank"))
    limits = asked.select(F.col("anchor_id").alias("vec_id"), "query", low.alias("low"), F.col("positive_score").alias("high"))
    second = query_blocks(mine.join(limits, "vec_id"), anchors * positives)
    found = search(second, packed, blocks, axes, negatives, False, tasks)
    best = _ranked(found, ["query"], negatives)
    out = best.join(asked.drop("rank"), "query").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    for table in (first, near, second):
        discard(table)
    return out
