"""Gradient-boosted histogram trees on Spark: own losses, several problems at a time, exact attributions.

Features are cut into bins once; a row is then a few bytes, its target and its margins. A level of
trees costs one aggregation: tasks sum gradients and Hessians by (tree, node, feature, bin) over their
Arrow batches, Spark adds the sums, and the driver, which sees histograms only, picks the splits.
Several problems (experts, years left out, thresholds) and all classes of a softmax grow side by side in
the same aggregations; a row says by a bit for each problem whether it trains or validates.

Rows of equal features and bits have equal margins, and gradients and losses are linear in what the
target adds up to, so such rows become one line with their number and sums, where that leaves about one
line for FOLD rows or fewer: before the bins are cut, or else after. All rows count; cuts and levels then
cost by the distinct lines and not by the rows.

Gradients of a line, and targets that are added up, are rounded to multiples of 2^-16, so that sums are
exact in any order and a fit repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import remove, stored
from .scores import running_counts

LOSSES = ("squared", "tweedie", "logistic", "softmax")
#: Rounds after which margins are written anew, instead of being summed over all trees in each task.
REFRESH = 10
#: Rows for each distinct line, on average, from which equal ones are added up.
FOLD = 3
#: Problems of a fit, at most: a bit of a long for each.
PROBLEMS = 62


@dataclass
class Tree:
    """A node table. Node 0 is the root; a leaf has feature -1. Left holds what is missing or at most the threshold."""

    feature: list[int]
    bin: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    cover: list[float]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        for _ in range(len(self.feature)):
            inner = feature[at] >= 0
            if not inner.any():
                break
            here = at[inner]
            at[inner] = np.where(bins[inner, feature[here]] <= cut[here], left[here], right[here])
        return at


@dataclass
class Boosted:
    """A fitted ensemble: rounds of one tree for each output; history has (training loss, validation loss or nan) before each round and at the end."""

    loss: str
    features: list[str]
    classes: list[int]
    edges: list[list[float]]
    start: list[float]
    trees: list[list[Tree]]
    gains: list[float]
    history: list[tuple[float, float]] = field(default_factory=list)
    power: float = 1.3


@dataclass(frozen=True)
class Problem:
    """Which rows train a model, and which decide when it stops, if any."""

    train: Column
    valid: Column | None = None


def mean_loss(loss: str, y: np.ndarray, margin: np.ndarray, power: float = 1.3) -> np.ndarray:
    """The loss of each row: half the squared error, Tweedie deviance, or log loss. margin: (rows, outputs)."""
    m = margin[:, 0]
    if loss == "squared":
        return 0.5 * (y - m) ** 2
    if loss == "tweedie":
        mu = np.exp(m)
        return 2 * (y ** (2 - power) / ((1 - power) * (2 - power)) - y * mu ** (1 - power) / (1 - power) + mu ** (2 - power) / (2 - power))
    if loss == "logistic":
        return np.logaddexp(0, m) - y * m
    top = margin.max(axis=1)
    return top + np.log(np.exp(margin - top[:, None]).sum(axis=1)) - margin[np.arange(len(y)), y.astype(np.int64)]


def gradients(loss: str, y: np.ndarray, margin: np.ndarray, power: float = 1.3) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives by the margin, (rows, outputs) each."""
    if loss == "squared":
        return margin - y[:, None], np.ones_like(margin)
    if loss == "tweedie":
        low, high = np.exp((1 - power) * margin), np.exp((2 - power) * margin)
        return high - y[:, None] * low, (2 - power) * high - (1 - power) * y[:, None] * low
    if loss == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return p - y[:, None], p * (1 - p)
    p = np.exp(margin - margin.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p - (np.arange(margin.shape[1])[None, :] == y[:, None]), p * (1 - p)


def _line_losses(loss: str, n: np.ndarray, y: np.ndarray, constant: np.ndarray, margin: np.ndarray, power: float) -> np.ndarray:
    """`mean_loss`, summed over the n rows of each line: y has the sums of the target (for softmax, rows of each class), constant what the margin leaves alone."""
    m, s = margin[:, 0], y[:, 0]
    if loss == "squared":
        return 0.5 * (constant - 2 * m * s + n * m * m)
    if loss == "tweedie":
        return 2 * (constant / ((1 - power) * (2 - power)) - s * np.exp((1 - power) * m) / (1 - power) + n * np.exp((2 - power) * m) / (2 - power))
    if loss == "logistic":
        return n * np.logaddexp(0, m) - s * m
    top = margin.max(axis=1)
    return n * (top + np.log(np.exp(margin - top[:, None]).sum(axis=1))) - (y * margin).sum(axis=1)


def _line_gradients(loss: str, n: np.ndarray, y: np.ndarray, margin: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """`gradients`, summed over the n rows of each line."""
    n = n[:, None]
    if loss == "squared":
        return n * margin - y, n * np.ones_like(margin)
    if loss == "tweedie":
        low, high = np.exp((1 - power) * margin), np.exp((2 - power) * margin)
        return n * high - y * low, n * ((2 - power) * high) - (1 - power) * y * low
    if loss == "logistic":
        p = 1 / (1 + np.exp(-margin))
    else:
        p = np.exp(margin - margin.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
    return n * p - y, n * (p * (1 - p))


def bins_of(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin numbers (rows, features): 0 for what is missing, then 1 and up."""
    out = np.zeros(values.shape, np.uint8)
    for k, e in enumerate(edges):
        v = values[:, k]
        out[:, k] = np.where(np.isnan(v), 0, 1 + np.searchsorted(np.array(e), v, "left"))
    return out


def _added(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lines of equal `by` as one."""
    return lines.groupBy(*by).agg(*(F.sum(c).alias(c) for c in lines.columns if c not in by))


def _plain(df: DataFrame, features: Sequence[str], target: Column, problems: Sequence[Problem], loss: str, outputs: int, power: float) -> DataFrame:
    """(v0, ..., train, valid, n, constant, y0, ...): features, a bit for each problem, one row and what it adds to sums."""
    flags = [sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(conditions) if c is not None), F.lit(0).cast("long")) for conditions in ([p.train for p in problems], [p.valid for p in problems])]
    values = [F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f"v{k}") for k, f in enumerate(features)]
    some = df.select(*values, flags[0].alias("train"), flags[1].alias("valid"), target.cast("double").alias("y"))
    some = some.where(F.col("y").isNotNull() & ((F.col("train") != 0) | (F.col("valid") != 0)))
    y = F.col("y")
    constant = y * y if loss == "squared" else F.pow(y, F.lit(2 - power)) if loss == "tweedie" else F.lit(0.0)
    parts = [F.when(y == k, 1.0).otherwise(0.0) for k in range(outputs)] if loss == "softmax" else [y]
    return some.select(*(f"v{k}" for k in range(len(features))), "train", "valid", F.lit(1.0).alias("n"), constant.alias("constant"), *(p.alias(f"y{k}") for k, p in enumerate(parts)))


def _exact(lines: DataFrame) -> DataFrame:
    return lines.withColumns({c: F.rint(F.col(c) * 65536) / 65536 for c in lines.columns if c.startswith("y")})


def _edges(lines: DataFrame, width: int, bins: int, folded: bool) -> list[list[float]]:
    """Upper ends of the bins of each feature but the last one's: distinct quantiles of the training rows, from counts where rows are added up."""
    train, levels = lines.where("train <> 0"), [k / bins for k in range(1, bins)]
    if folded:
        pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("v")) for k in range(width)))
        counts, path = stored(train.select("n", F.inline(pairs)).groupBy("k", "v").agg(F.sum("n").alias("n")), "boosting-counts")
        placed = running_counts(counts, "v", {"n": F.sum("n")}, ["k"])
        found = placed.groupBy("k").agg(F.max("v").alias("m"), F.array(*(F.min(F.when(F.col("n_below") + F.col("n") >= F.ceil(F.col("n_all") * level), F.col("v"))) for level in levels)).alias("q"))
        rows = {r.k: r for r in found.collect()}  # a row a feature
        remove(lines.sparkSession, path)
        return [sorted({x for x in rows[k].q if x < rows[k].m}) if k in rows else [] for k in range(width)]
    row = train.agg(*(F.percentile_approx(f"v{k}", F.array(*map(F.lit, levels)), 10_000).alias(f"q{k}") for k in range(width)), *(F.max(f"v{k}").alias(f"m{k}") for k in range(width))).first()
    return [sorted({x for x in row[f"q{k}"] or [] if x < row[f"m{k}"]}) for k in range(width)]


def _encoded(lines: DataFrame, edges: list[list[float]], start: np.ndarray, folded: bool) -> DataFrame:
    """(x, train, valid, n, constant, margin, y0, ...): lines with bins for features and the margins of all problems' outputs."""
    width, by = len(edges), ["x", "train", "valid"]
    rest = lines.columns[width:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = bins_of(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(width)], axis=1), edges)
                yield pa.RecordBatch.from_arrays([_strings(x), *(batch.column(k) for k in range(width, batch.num_columns))], ["x", *rest])

    def binned(df: DataFrame) -> DataFrame:
        return df.mapInArrow(run, "x binary, train long, valid long, " + ", ".join(f"{c} double" for c in rest[2:]))

    many = lines.sparkSession.sparkContext.defaultParallelism
    if not folded:
        rows, kinds = binned(lines).agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*by))).first()
        out = _added(_exact(binned(lines)), by).repartition(many) if kinds * FOLD <= rows else binned(lines.repartition(many))
    else:
        out = _added(binned(lines), by).repartition(many)
    return out.select(*by, "n", "constant", F.lit(start.tobytes()).alias("margin"), *(c for c in rest if c.startswith("y")))


def _strings(table: np.ndarray) -> pa.Array:
    """The lines of a table as byte strings."""
    n, width = len(table), table.shape[1] * table.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(table).tobytes())])


def _numbers(column: pa.Array, kind, n: int) -> np.ndarray:
    """Byte strings of equal length as the lines of a table."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(kind).reshape(n, -1)


def _advanced(margin: np.ndarray, x: np.ndarray, rounds: list[list[Tree | None]]) -> np.ndarray:
    margin = margin.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            if tree is not None:
                margin[:, k] += np.array(tree.value)[tree.leaf_of(x)]
    return margin


def _histograms(table: DataFrame, rounds: list, growing: list[Tree | None], frontier: list[dict[int, int]], shape: tuple[int, int, int, int], outputs: int, loss: str, power: float, losses: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums (output, node, feature, bin, (g, h, n)) at the frontier, and (problem, (training loss, n, validation loss, n))."""
    k_all, nodes, features, bins = shape
    count = k_all // outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, told = np.zeros((k_all, nodes, features, bins, 3)), np.zeros((count, 4))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _numbers(batch.column(0), np.uint8, batch.num_rows)
            train, valid, n, constant = (batch.column(k).to_numpy() for k in (1, 2, 3, 4))
            margin = _advanced(_numbers(batch.column(5), np.float64, batch.num_rows), x, rounds)
            y = np.stack([batch.column(k).to_numpy() for k in range(6, batch.num_columns)], axis=1)
            for p in range(count):
                own = slice(p * outputs, (p + 1) * outputs)
                mine = (train >> p) & 1 == 1
                if losses:
                    for at, rows in ((0, mine), (2, (valid >> p) & 1 == 1)):
                        told[p, at] += _line_losses(loss, n[rows], y[rows], constant[rows], margin[rows, own], power).sum()
                        told[p, at + 1] += n[rows].sum()
                if not any(frontier[own]):
                    continue
                xm, nm = x[mine], n[mine]
                g, h = _line_gradients(loss, nm, y[mine], margin[mine, own], power)
                g, h = np.round(g * 65536) / 65536, np.round(h * 65536) / 65536
                for k in range(outputs):
                    places = frontier[p * outputs + k]
                    if not places:
                        continue
                    tree = growing[p * outputs + k]
                    place = np.full(len(tree.feature), -1)
                    place[list(places)] = list(places.values())
                    at = place[tree.leaf_of(xm)]
                    live = at >= 0
                    base, xs, gs, hs, ns = at[live] * bins, xm[live], g[live, k], h[live, k], nm[live]
                    for f in range(features):
                        slot = base + xs[:, f]
                        for j, w in enumerate((gs, hs, ns)):
                            sums[p * outputs + k, :, f, :, j] += np.bincount(slot, w, nodes * bins).reshape(nodes, bins)
        flat = sums.reshape(-1, 3)
        some = np.flatnonzero(flat[:, 2])
        extra = np.concatenate([told.reshape(-1, 2), np.zeros((2 * count, 1))], axis=1)
        slots, values = np.concatenate([some, -1 - np.arange(2 * count)]), np.concatenate([flat[some], extra])
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), *(pa.array(values[:, j]) for j in range(3))], ["slot", "g", "h", "n"])

    got = table.mapInArrow(run, "slot long, g double, h double, n double").groupBy("slot").agg(F.sum("g"), F.sum("h"), F.sum("n")).toArrow()  # histograms: outputs x nodes x features x bins
    slots, values = got.column(0).to_numpy(), np.stack([got.column(j).to_numpy() for j in (1, 2, 3)], axis=1)
    sums = np.zeros((k_all * nodes * features * bins, 3))
    sums[slots[slots >= 0]] = values[slots >= 0]
    told = np.zeros((2 * count, 2))
    told[-1 - slots[slots < 0]] = values[slots < 0][:, :2]
    return sums.reshape(k_all, nodes, features, bins, 3), told.reshape(count, 4)


def _best_split(hist: np.ndarray, least_rows: int, l2: float) -> tuple[float, int, int, np.ndarray, np.ndarray] | None:
    """(gain, feature, bin, sums left, sums right) of the best split of one node; ties go to the first feature, then the lowest bin."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    total = hist[0].sum(axis=0)
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    gain = np.where((left[..., 2] >= least_rows) & (right[..., 2] >= least_rows), score(left) + score(right) - score(total), -np.inf)
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b, left[f, b], right[f, b]) if gain[f, b] > 1e-9 else None


def fit(
    df: DataFrame, features: Sequence[str], target: Column, loss: str, problems: Sequence[Problem], rounds: int = 20, rate: float = 0.1, depth: int = 4, bins: int = 64,
    least_rows: int = 20, l2: float = 1.0, power: float = 1.3, patience: int = 50, classes: Sequence[int] = (0,),
) -> list[Boosted]:
    """One model for each problem (62 at most), all grown together. For softmax the target is the place of the class in `classes`.

    A model stops when its validation loss has not fallen for `patience` rounds, and keeps the rounds up
    to its least one; without validation rows it takes all rounds. A class without training rows gets
    no tree and a probability of zero. Rows without a target take no part; missing features go left. A
    problem without training rows predicts zero rain, a half, or its only class.
    """
    if loss not in LOSSES or not 1 <= len(problems) <= PROBLEMS or not 2 <= bins <= 254:
        raise ValueError("unknown loss, or too many problems or bins")
    spark = df.sparkSession
    outputs = len(classes) if loss == "softmax" else 1
    k_all = outputs * len(problems)
    lines, by = _plain(df, features, target, problems, loss, outputs, power), [*(f"v{k}" for k in range(len(features))), "train", "valid"]
    sums = lines.agg(
        *(F.sum(F.when(F.col("train").bitwiseAND(1 << i) != 0, F.col(f"y{k}"))).alias(f"s{i}_{k}") for i in range(len(problems)) for k in range(outputs)),
        *(F.count(F.when(F.col("train").bitwiseAND(1 << i) != 0, 1)).alias(f"n{i}") for i in range(len(problems))), F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64(*by)).alias("kinds"),
    ).first()
    folded, kept = sums["kinds"] * FOLD <= sums["rows"], None
    if folded:
        lines, kept = stored(_added(_exact(lines), by), "boosting-lines")
    edges = _edges(lines, len(features), bins, folded)
    start = np.zeros(k_all)
    for i in range(len(problems)):
        for k in range(outputs):
            mean = (sums[f"s{i}_{k}"] or 0.0) / max(1, sums[f"n{i}"])
            if loss == "squared":
                start[i * outputs + k] = mean
            elif loss == "logistic":
                start[i * outputs + k] = math.log(max(mean, 1e-9) / max(1 - mean, 1e-9)) if sums[f"n{i}"] else 0.0
            else:
                start[i * outputs + k] = math.log(mean) if mean > 0 else -700.0
    models = [Boosted(loss, list(features), list(classes), edges, start[i * outputs : (i + 1) * outputs].tolist(), [], [0.0] * len(features), [], power) for i in range(len(problems))]
    table, path = stored(_encoded(lines, edges, start, folded), "boosting")
    if kept:
        remove(spark, kept)
    width, pending, active = max(len(e) for e in edges) + 2, [], {i for i in range(len(problems)) if sums[f"n{i}"]}
    for turn in range(rounds + 1):
        growing: list[Tree | None] = [None] * k_all
        frontier: list[dict[int, int]] = [{} for _ in range(k_all)]
        for i in active if turn < rounds else ():
            for k in range(outputs):
                if start[i * outputs + k] > -700.0:
                    growing[i * outputs + k] = Tree([-1], [0], [0.0], [0], [0], [0.0], [float(sums[f"n{i}"])])
                    frontier[i * outputs + k] = {0: 0}
        for level in range(depth if turn < rounds else 1):
            nodes = max([1, *map(len, frontier)])
            hist, told = _histograms(table, pending, growing, frontier, (k_all, nodes, len(features), width), outputs, loss, power, level == 0)
            if level == 0:
                for i in sorted(active):
                    models[i].history.append((told[i, 0] / max(1, told[i, 1]), told[i, 2] / told[i, 3] if told[i, 3] else math.nan))
                    valid = [v for _, v in models[i].history]
                    if not math.isnan(valid[0]) and len(valid) - 1 - int(np.argmin(valid)) >= patience:
                        active.discard(i)
                        for k in range(outputs):
                            growing[i * outputs + k], frontier[i * outputs + k] = None, {}
            for k, places in enumerate(frontier):
                tree, after = growing[k], {}
                for node, place in places.items():
                    found = _best_split(hist[k, place], least_rows, l2)
                    if found is None:
                        if level == 0:
                            tree.value[0] = 0.0
                        continue
                    gain, f, b, *sides = found
                    models[k // outputs].gains[f] += gain
                    tree.feature[node], tree.bin[node], tree.threshold[node] = f, b, edges[f][b - 1] if b else -math.inf
                    for side, (g, h, n) in zip((tree.left, tree.right), sides):
                        side[node] = len(tree.feature)
                        after[len(tree.feature)] = len(after)
                        for column, v in zip((tree.feature, tree.bin, tree.threshold, tree.left, tree.right, tree.value, tree.cover), (-1, 0, 0.0, 0, 0, float(-rate * g / (h + l2)), float(n))):
                            column.append(v)
                frontier[k] = after
            if not any(frontier):
                break
        if not active or turn == rounds:
            break
        pending.append(growing)
        for i in active:
            models[i].trees.append([growing[i * outputs + k] for k in range(outputs)])
        if len(pending) == REFRESH:
            was, done = path, list(pending)

            def refreshed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if n := batch.num_rows:
                        margin = _advanced(_numbers(batch.column(5), np.float64, n), _numbers(batch.column(0), np.uint8, n), done)
                        yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(5)), _strings(margin), *(batch.column(j) for j in range(6, batch.num_columns))], batch.schema.names)

            table, path = stored(table.mapInArrow(refreshed, table.schema), "boosting")
            remove(spark, was)
            pending = []
    remove(spark, path)
    for m in models:
        valid = [v for _, v in m.history]
        if valid and not math.isnan(valid[0]):
            m.trees = m.trees[: int(np.argmin(valid))]
    return models


# ---------------------------------------------------------------- prediction
def _tree_column(model: Boosted, tree: Tree, node: int = 0) -> Column:
    if tree.feature[node] < 0:
        return F.lit(tree.value[node])
    x = F.nanvl(F.col(model.features[tree.feature[node]]).cast("double"), F.lit(None))
    left = x.isNull() if math.isinf(tree.threshold[node]) else F.coalesce(x <= tree.threshold[node], F.lit(True))
    return F.when(left, _tree_column(model, tree, tree.left[node])).otherwise(_tree_column(model, tree, tree.right[node]))


def margin(model: Boosted, output: int = 0) -> Column:
    """The sum of the trees, as an expression over the feature columns."""
    out = F.lit(model.start[output])
    for trees in model.trees:
        if trees[output] is not None:
            out = out + _tree_column(model, trees[output])
    return out


def prediction(model: Boosted) -> Column:
    """The mean of a squared or Tweedie model, the probability of a logistic one."""
    m = margin(model)
    return m if model.loss == "squared" else F.exp(m) if model.loss == "tweedie" else 1 / (1 + F.exp(-m))


def with_probabilities(model: Boosted, df: DataFrame, prefix: str = "p_") -> DataFrame:
    """A column of each class's probability; 0 for a class that had no training rows."""
    return with_probabilities_of([model], df, F.lit(0), prefix)


def with_probabilities_of(models: Sequence[Boosted], df: DataFrame, chosen: Column, prefix: str = "p_") -> DataFrame:
    """As `with_probabilities`, each row by the model whose place `chosen` gives, in one pass; all models have the same classes."""
    classes = models[0].classes

    def own(each) -> Column:
        out = each(models[-1])
        for k, model in enumerate(models[:-1]):
            out = F.when(F.col("_model") == k, each(model)).otherwise(out)
        return out

    raw = df.withColumn("_model", chosen)
    raw = raw.withColumns({f"_m{k}": own(lambda m, k=k: margin(m, k)) for k in range(len(classes))})
    top = F.greatest(*(F.col(f"_m{k}") for k in range(len(classes)))) if len(classes) > 1 else F.col("_m0")
    raw = raw.withColumn("_top", top)
    parts = [own(lambda m, k=k: F.exp(F.col(f"_m{k}") - F.col("_top")) if m.start[k] > -700.0 else F.lit(0.0)) for k in range(len(classes))]
    out = raw.withColumns({f"{prefix}{c}": part for c, part in zip(classes, parts)})
    whole = sum((F.col(f"{prefix}{c}") for c in classes), F.lit(0.0))
    return out.withColumn("_whole", whole).withColumns({f"{prefix}{c}": F.col(f"{prefix}{c}") / F.col("_whole") for c in classes}).drop("_model", "_top", "_whole", *(f"_m{k}" for k in range(len(classes))))


def importance(model: Boosted) -> list[tuple[str, float]]:
    """Shares of the gain by feature, the largest first, then by name."""
    total = sum(model.gains) or 1.0
    return sorted(((f, round(g / total, 4)) for f, g in zip(model.features, model.gains)), key=lambda x: (-x[1], x[0]))


# ---------------------------------------------------------------- attributions
def leaf_shares(tree: Tree, leaf: int, path: list[tuple[int, bool, float, float]]) -> tuple[list[int], list[tuple[float, float, list[bool]]], np.ndarray]:
    """What a leaf adds to each feature on its path, for each combination of path features that a row follows.

    path: (feature, left, threshold, share of the cover that follows). Returns the features, and a table
    (2^features, features); bit j of a line says that the row follows all conditions on feature j.
    """
    features = sorted({f for f, *_ in path})
    m = len(features)
    zero = np.array([math.prod(s for f, _, _, s in path if f == g) for g in features])
    follows = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    weight = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
    out = np.zeros((1 << m, m))
    for i in range(m):
        # Coefficient s: the sum over sets of s other features that are known, of the product of what each side passes on.
        known = np.zeros((1 << m, m))
        known[:, 0] = 1.0
        for j in range(m):
            if j != i:
                known[:, 1:] = known[:, 1:] * zero[j] + known[:, :-1] * follows[:, [j]]
                known[:, 0] *= zero[j]
        out[:, i] = tree.value[leaf] * (follows[:, i] - zero[i]) * (known @ np.array(weight))
    return features, path, out


def _leaves(tree: Tree) -> Iterator[tuple[int, list[tuple[int, bool, float, float]]]]:
    todo = [(0, [])]
    while todo:
        node, path = todo.pop()
        if tree.feature[node] < 0:
            yield node, path
        else:
            for child, is_left in ((tree.left[node], True), (tree.right[node], False)):
                todo.append((child, [*path, (tree.feature[node], is_left, tree.threshold[node], tree.cover[child] / tree.cover[node])]))


def base_value(model: Boosted, output: int = 0) -> float:
    """The cover-weighted mean of the margin."""
    return model.start[output] + sum(tree.value[leaf] * math.prod(s for *_, s in path) for trees in model.trees if (tree := trees[output]) is not None for leaf, path in _leaves(tree))


def contributions(model: Boosted, output: int = 0) -> Column:
    """array<double>: each feature's exact Shapley value of the margin, in the order of the model's features.

    Path-dependent: a feature that is not known splits by the cover of the training rows. With
    `base_value` they add up to the margin. Tables of what each leaf adds are made once; a batch of rows
    looks them up by the conditions it follows.
    """
    tables = [leaf_shares(tree, leaf, path) for trees in model.trees if (tree := trees[output]) is not None for leaf, path in _leaves(tree) if path]
    width = len(model.features)

    def run(*columns):
        import pandas as pd

        values = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns], axis=1)
        out = np.zeros((len(values), width))
        for features, path, shares in tables:
            follows = np.ones((len(values), len(features)), bool)
            for f, is_left, threshold, _ in path:
                v = values[:, f]
                left = np.isnan(v) | (v <= threshold)
                follows[:, features.index(f)] &= left if is_left else ~left
            out[:, features] += shares[follows @ (1 << np.arange(len(features)))]
        return pd.Series(list(out))

    return F.pandas_udf(run, "array<double>")(*(F.col(f).cast("double") for f in model.features))
