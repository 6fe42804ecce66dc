"""Gradient boosting over a stored residual column (M4), with patience and resumable.

A round fits one regression tree to the residuals of the fit rows (squared loss, so the leaf means are
the steps) and takes ``step`` of it; the mean absolute error of the validation rows is kept for every round.
Training ends after ``patience`` rounds without a new best error, or after ``rounds``; the model is that
of the best round, as Spark ML trees.

A tree looks at a row's features only through the bins between its split candidates, and these are the same in
every round. So they are found once (Spark ML's rule, on evenly spaced ranks of all fit rows), and rows are
reduced to cells, without loss: fit rows of equal bins to their count, mean residual and spread, which is all that a
squared-loss split needs; validation rows of equal bins and equal residual to their count, as the absolute error needs
each residual. Cells lie in blocks of columns, kept by the executors: a round is a job a tree level, which sums up the histograms
of (node, feature, bin), and the root's job also takes the step before and the error. Up to ``HERE_BYTES`` of blocks are worked on by the
driver instead, by the same code, since there the jobs would cost more than the sums.

Every ``stage`` rounds the trees, the cells' new residuals and the errors so far are written to
the run's folder, so no plan grows with the rounds, and a run that died goes on after its last whole stage.
What a level sends to the driver is a histogram a task, or of many tasks a few sums.
"""

from __future__ import annotations

import json
import math
import sys
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.ml.wrapper import JavaWrapper
from pyspark.serializers import CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

RESIDUAL = "residual"
MAX_BINS = 32  # of a feature, as Spark ML's default
RANKS = 10_000  # values a feature's split candidates are chosen from, and the error of a rank is 1 / RANKS
BLOCK = 1 << 15  # cells
PART_BYTES = 128 << 20  # of blocks in a task, which takes them one by one
HERE_BYTES = 64 << 20  # of blocks, about two million cells, that the driver works on itself


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _file_system(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def ensemble(spark: SparkSession, trees: list, step: float):
    """One model (of the JVM) of the JVM's ``trees``, each with weight ``step``: rows pass all of them in one projection."""
    kind = spark._jvm.org.apache.spark.ml.regression
    members = JavaWrapper._new_java_array(trees, kind.DecisionTreeRegressionModel)
    weights = JavaWrapper._new_java_array([float(step)] * len(trees), spark._sc._gateway.jvm.double)
    return kind.GBTRegressionModel(f"boost_{uuid.uuid4().hex[:12]}", members, weights)


def _keep(spark: SparkSession, values: list, number: str, name: str, kind: str, path: str) -> None:
    """A list written as (number, value) rows, without a Python task."""
    (spark.range(1, numPartitions=1).select(F.posexplode(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")).alias(number, name))
     .write.mode("overwrite").parquet(path))


def best_round(history: list[float]) -> int:
    """The first round (from 0, which is the plain mean) of the least error; the last round where no error was kept."""
    known = [e for e in history if e is not None]
    return min(range(len(known)), key=lambda i: (known[i], i)) if known else len(history) - 1


# --------------------------------------------------------------------------- split candidates and cells

def split_points(ranked: np.ndarray) -> np.ndarray:
    """The split candidates of a feature from values at evenly spaced ranks, by Spark ML's rule: midpoints of all neighbouring
    values where these are few, else those next to every 1 / ``MAX_BINS`` of the values."""
    values, counts = np.unique(ranked[~np.isnan(ranked)], return_counts=True)
    if len(values) <= MAX_BINS:
        return np.unique((values[1:] + values[:-1]) / 2)
    stride = target = counts.sum() / MAX_BINS
    found, seen = [], np.cumsum(counts)
    for i in range(1, len(values)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            found.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.unique(found)


def _cuts(rows: DataFrame) -> list[np.ndarray]:
    """The split candidates of every feature, from all fit rows. Without fit rows there is nothing to learn: ValueError."""
    fit = rows.where("not is_validation")
    n, width, bad = fit.agg(F.count(F.lit(1)), F.max(F.size("x")), F.count_if(F.col(RESIDUAL).isNull() | F.isnan(RESIDUAL))).first()
    if not n:
        raise ValueError("no rows to learn from")
    if bad:
        raise ValueError(f"{bad} rows to learn from without a residual")
    points = min(n, RANKS)
    grid = ((np.arange(points) + 0.5) / points).tolist()  # of few rows, each of them once
    # not as an aggregate: so many numbers in a plan fill the driver with the plan's texts
    found = fit.select(*[F.col("x")[i].alias(f"x{i}") for i in range(width)]).approxQuantile([f"x{i}" for i in range(width)], grid, 1 / RANKS)
    return [split_points(np.array(v, float)) for v in found]


def _used(cuts: list[np.ndarray]) -> list[int]:
    """The features that have candidates; one without any where none has."""
    return [i for i, cut in enumerate(cuts) if len(cut)] or [0]


def _to_bins(cuts: list[np.ndarray]):
    """mapInArrow function: (x, residual, is_validation) -> (bins, one byte a feature; residual, is_validation)."""
    def run(batches):
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, len(cuts))
            bins = np.empty(x.shape, np.uint8)
            for f, cut in enumerate(cuts):
                bins[:, f] = np.searchsorted(cut, x[:, f], "left")
            at = np.arange(b.num_rows + 1, dtype=np.int32) * len(cuts)
            key = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([key, b.column(1), b.column(2)], ["bins", RESIDUAL, "is_validation"])
    return run


def _to_blocks(features: int):
    """mapInArrow function: cells -> blocks of up to ``BLOCK`` fit cells or validation cells, each column as bytes."""
    names = ["is_validation", "n", "bins", "residual", "weight", "spread"]

    def run(batches):
        waiting = {True: [], False: []}

        def block(flag, enough):
            while waiting[flag] and sum(len(c[1]) for c in waiting[flag]) >= enough:
                bins, n, s, q = (np.concatenate(c) for c in zip(*waiting[flag]))
                waiting[flag] = [(bins[BLOCK:], n[BLOCK:], s[BLOCK:], q[BLOCK:])] if len(n) > BLOCK else []
                bins, n, s, q = bins[:BLOCK], n[:BLOCK], s[:BLOCK], q[:BLOCK]
                spread = b"" if flag else np.maximum(q - s * s / n, 0.0).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (flag, len(n), np.ascontiguousarray(bins.T).tobytes(), (s / n).tobytes(), n.tobytes(), spread)], names)

        for b in batches:
            flags = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            offsets = np.frombuffer(b.column(0).buffers()[1], np.int32)[b.column(0).offset:]
            bins = np.frombuffer(b.column(0).buffers()[2], np.uint8)[offsets[0]:offsets[0] + b.num_rows * features].reshape(b.num_rows, features)
            numbers = [b.column(i).to_numpy().astype(float) for i in (2, 3, 4)]
            for flag in (True, False):
                at = flags == flag
                if at.any():
                    waiting[flag].append((bins[at], *[v[at] for v in numbers]))
                yield from block(flag, BLOCK)
        for flag in (True, False):
            yield from block(flag, 1)
    return run


# A block: whether its cells are of validation rows; then by cell the bins (a row of them for each feature used), the mean residual,
# the count of rows, and the sum of squared differences from that mean (none for validation rows).
Block = tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _block(row) -> Block:
    number = lambda v: np.frombuffer(bytes(v), float)
    return row[0], np.frombuffer(bytes(row[2]), np.uint8).reshape(-1, row[1]), number(row[3]), number(row[4]), number(row[5])


def _cells(rows: DataFrame, cuts: list[np.ndarray]) -> RDD:
    take = _used(cuts)
    wanted = [cuts[i] for i in take]
    given = rows.where(f"is_validation is not null and {RESIDUAL} is not null").select(
        F.array(*[F.col("x")[i] for i in take]).cast("array<double>").alias("x"), RESIDUAL, "is_validation")
    y = F.col(RESIDUAL)
    cells = (given.mapInArrow(_to_bins(wanted), f"bins binary, {RESIDUAL} double, is_validation boolean")
             .groupBy("bins", "is_validation", F.when(F.col("is_validation"), y).alias("y"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
             .select("bins", "is_validation", "n", "s", "q"))
    blocks = cells.mapInArrow(_to_blocks(len(wanted)), "is_validation boolean, n long, bins binary, residual binary, weight binary, spread binary")
    return blocks.rdd.map(_block)


class Cells:
    """Blocks kept by the executors, or a list of the few that the driver works on."""

    def __init__(self, spark: SparkSession, blocks: RDD | list[Block]):
        self.spark, self.blocks, self.here = spark, blocks, isinstance(blocks, list)
        if not self.here:
            blocks.persist(StorageLevel.MEMORY_AND_DISK)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Cells:
        """In as many parts as cores, or more where a part would grow too large."""
        sc = spark.sparkContext
        fs, place = _file_system(spark, path)
        size = fs.getContentSummary(place).getLength()
        parts = max(math.ceil(size / PART_BYTES), min(sc.defaultParallelism, math.ceil(size / (2 << 20))), 1)
        blocks = sc.pickleFile(path, parts).coalesce(parts)
        return Cells(spark, blocks.collect() if size <= HERE_BYTES else blocks)

    def save(self, path: str) -> None:
        _save(self.spark.sparkContext.parallelize(self.blocks, max(len(self.blocks) // 8, 1)) if self.here else self.blocks, self.spark, path)

    def map(self, step) -> Cells:
        return Cells(self.spark, [step(b) for b in self.blocks] if self.here else self.blocks.map(step))

    def total(self, of) -> np.ndarray:
        """The sum over all parts of ``of(blocks)``, an array; many parts are added up by the executors first."""
        if self.here:
            return of(self.blocks)
        parts = self.blocks.mapPartitions(lambda it: [of(it)])
        return np.sum(parts.collect(), axis=0) if parts.getNumPartitions() <= 64 else parts.treeReduce(np.add)

    def forget(self) -> None:
        if not self.here:
            self.blocks.unpersist()


def _save(blocks: RDD, spark: SparkSession, path: str) -> None:
    remove(spark, path)  # of a run that died while it wrote
    blocks.saveAsPickleFile(path, 1)


# --------------------------------------------------------------------------- trees

# A tree has its full depth, by levels: feature and last bin of the left side of every node. A node that is not split sends
# all its rows to the left, and its mean is found at the leftmost leaf below.
Levels = list[tuple[np.ndarray, np.ndarray]]


def _leaf(levels: Levels, bins: np.ndarray) -> np.ndarray:
    """The node of the last level that each cell falls into."""
    flat, n = bins.ravel(), bins.shape[1]
    node, at = np.zeros(n, np.int32), np.arange(n, dtype=np.int32)
    for feature, cut in levels:
        x = flat.take((feature * n).astype(np.int32).take(node) + at) if len(feature) > 1 else bins[feature[0]]
        right = x > cut.astype(np.uint8).take(node)
        node += node
        node += right
    return node.astype(np.intp)


def _histogram(blocks, levels: Levels, features: int, squares: bool) -> np.ndarray:
    """Counts, residual sums and (with ``squares``) sums of squared residuals of the fit rows by node below ``levels``, feature and bin."""
    size = MAX_BINS << len(levels)
    out = np.zeros((2 + squares, features, size))
    for is_validation, bins, residual, weight, spread in blocks:
        if not is_validation:
            node = _leaf(levels, bins) * MAX_BINS
            sums = [weight, weight * residual]
            if squares:
                sums.append(spread + sums[1] * residual)
            for f in range(features):
                at = node + bins[f]
                for i, v in enumerate(sums):
                    out[i, f] += np.bincount(at, v, size)
    return out.ravel()


def _step(levels: Levels, value: np.ndarray, weight: float):
    """Function of a block: the residual that ``weight`` of the tree leaves."""
    def run(block: Block) -> Block:
        is_validation, bins, residual, *rest = block
        return is_validation, bins, residual - weight * value[_leaf(levels, bins)], *rest
    return run


def _error_and_root(blocks, features: int) -> np.ndarray:
    """Sum of absolute residuals and count of the validation rows, then the root's histogram."""
    error, out = np.zeros(2), np.zeros(3 * features * MAX_BINS)
    for block in blocks:
        if block[0]:
            error += (np.abs(block[2]) * block[3]).sum(), block[3].sum()
        else:
            out += _histogram([block], [], features, True)
    return np.concatenate([error, out])


def _best_splits(counts: np.ndarray, sums: np.ndarray, bins: list[int]) -> list[tuple | None]:
    """For every node (feature, last bin of the left side, gain) of the best gain of the variance, the first of equals; None where no
    split gains. ``counts`` and ``sums``: of the bins up to each, by node, feature and bin."""
    all_n, all_s = counts[:, :1, -1:], sums[:, :1, -1:]
    right_n, right_s = counts[..., -1:] - counts, sums[..., -1:] - sums
    with np.errstate(divide="ignore", invalid="ignore"):
        sides = sums ** 2 / counts + right_s ** 2 / right_n
        gain = (sides - all_s ** 2 / all_n) / all_n
        # what rounding leaves is no gain
        fit = (counts > 0) & (right_n > 0) & (gain * all_n > 1e-12 * sides) & (np.arange(MAX_BINS) < np.array(bins)[:, None] - 1)
    gain = np.where(fit, gain, 0.0).reshape(len(counts), -1)
    return [(*divmod(int(at), MAX_BINS), float(g[at])) if g[at] > 0 else None for at, g in zip(gain.argmax(1), gain)]


def _grow(cells: Cells, root: np.ndarray, bins: list[int], depth: int) -> tuple[Levels, np.ndarray, dict, np.ndarray]:
    """The tree of the cells' residuals with its means by leaf, what its nodes hold (by level and number: count, sum, split), and the
    squared residuals by leaf."""
    levels, nodes = [], {}
    for level in range(depth):
        last = level == depth - 1
        found = cells.total(lambda it, t=list(levels), q=last: _histogram(it, t, len(bins), q)) if level else root
        # sums of the bins up to each, by node, feature and bin
        sums = found.reshape(-1, len(bins), 1 << level, MAX_BINS).transpose(0, 2, 1, 3).cumsum(3)
        if not level:
            nodes[0, 0] = [float(sums[0, 0, 0, -1]), float(sums[1, 0, 0, -1]), None]
        feature, cut = np.zeros(1 << level, np.intp), np.full(1 << level, 255, np.intp)
        for node, split in enumerate(_best_splits(sums[0], sums[1], bins)):
            # the rows of a node that was not split stay together at the left, and are not split later
            if split and (level, node) in nodes:
                feature[node], cut[node] = split[:2]
                nodes[level, node][2] = split
                left, whole = sums[:2, node, split[0], split[1]], sums[:2, node, split[0], -1]
                for side, (n, s) in enumerate((left, whole - left)):
                    nodes[level + 1, 2 * node + side] = [float(n), float(s), None]
        levels.append((feature, cut))
        if last:
            at = np.arange(1 << level)
            left = sums[2][at, feature, np.minimum(cut, MAX_BINS - 1)]
            squares = np.column_stack([left, sums[2][at, feature, -1] - left]).ravel()
    value = np.zeros(1 << depth)
    for (level, node), (n, s, split) in nodes.items():
        if split is None:
            value[node << (depth - level)] = s / n
    return levels, value, nodes, squares


def _as_model(spark: SparkSession, nodes: dict, squares: np.ndarray, cuts: list[np.ndarray]):
    """The tree as the JVM's model of Spark ML: means, variances, counts and gains of its nodes, splits at the candidates' values."""
    jvm, origin = spark._jvm, _used(cuts)
    # each dot, each array element and each new object is a call to the JVM: names are looked up once, numbers sent at once
    part, calculator = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
    leaf, inner, continuous = part.LeafNode, part.InternalNode, part.ContinuousSplit
    numbers = {}
    for (level, node), (n, s, _) in nodes.items():
        width = len(squares) >> level
        numbers[level, node] = array("d", (n, s, squares[node * width:(node + 1) * width].sum()))
    place = {key: i for i, key in enumerate(numbers)}
    sent = jvm.org.apache.spark.ml.python.MLSerDe.loads(bytearray(CPickleSerializer().dumps(list(numbers.values()))))

    def build(level, node):
        (n, s, q), split = numbers[level, node], nodes[level, node][2]
        mean, variance, about = s / n, max(q / n - (s / n) ** 2, 0.0), calculator(sent.get(place[level, node]), int(n))
        if split is None:
            return leaf(mean, variance, about)
        f, k, gain = split
        return inner(mean, variance, gain, build(level + 1, 2 * node), build(level + 1, 2 * node + 1),
                     continuous(origin[f], float(cuts[origin[f]][k])), about)

    return jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel(f"tree_{uuid.uuid4().hex[:12]}", build(0, 0), len(cuts))


# --------------------------------------------------------------------------- rounds

def boost(data: DataFrame, path: str, rounds: int = 1000, depth: int = 6, step: float = 0.1, patience: int = 50,
          stage: int = 10, seed: int = 42) -> tuple[GBTRegressionModel, list[float]]:
    """The model of the best round and the validation error after 0, 1, ... rounds (None without validation rows;
    then all ``rounds`` run and count). ``data``: ``features`` (vector), ``residual`` (label less its mean),
    ``is_validation``. ``path``: the run's folder; where it holds whole stages, training goes on after them and
    ``data`` is not read again. Nothing here is drawn at random: ``seed`` changes nothing. Without fit rows there is
    nothing to learn: ValueError."""
    spark = data.sparkSession
    place = lambda n, part: f"{path}/stage-{n:05d}/{part}"
    done = 0
    while exists(spark, place(done + 1, "history/_SUCCESS")):
        done += 1
    if not done and not exists(spark, place(0, "rows/_SUCCESS")):
        (data.select(vector_to_array("features").alias("x"), F.col(RESIDUAL).cast("double").alias(RESIDUAL), "is_validation")
         .write.mode("overwrite").parquet(place(0, "given")))
        given = spark.read.parquet(place(0, "given"))
        cuts = _cuts(given)
        _keep(spark, [cut.tolist() for cut in cuts], "feature", "cut", "array<double>", place(0, "cuts"))
        _save(_cells(given, cuts), spark, place(0, "rows"))
        remove(spark, place(0, "given"))
    cuts = [np.array(r["cut"], float) for r in spark.read.parquet(place(0, "cuts")).orderBy("feature").collect()]
    bins = [len(cuts[i]) + 1 for i in _used(cuts)]
    trees = [t for n in range(1, done + 1) for t in GBTRegressionModel.load(place(n, "trees"))._java_obj.trees()]

    def look(cells):
        found = cells.total(lambda it: _error_and_root(it, len(bins)))
        return (float(found[0] / found[1]) if found[1] else None), found[2:]

    cells = Cells.load(spark, place(done, "rows"))
    error, root = look(cells)
    history = [r["error"] for r in spark.read.parquet(place(done, "history")).orderBy("round").collect()] if done else [error]
    over = lambda: len(trees) >= rounds or len(history) - 1 - best_round(history) >= patience
    while not over():
        fresh = []
        while len(fresh) < stage and not over():
            levels, value, nodes, squares = _grow(cells, root, bins, depth)
            fresh.append(_as_model(spark, nodes, squares, cuts))
            trees.append(fresh[-1])
            left = cells.map(_step(levels, value, ensemble(spark, fresh[-1:], step).treeWeights()[0]))
            error, root = look(left)
            history.append(error)
            cells.forget()
            cells = left
        done += 1
        ensemble(spark, fresh, step).write().overwrite().save(place(done, "trees"))
        cells.save(place(done, "rows"))
        # written last: a stage without it is taken again
        _keep(spark, history, "round", "error", "double", place(done, "history"))
        remove(spark, place(done - 1, "rows"))
        if not cells.here:
            cells.forget()
            cells = Cells.load(spark, place(done, "rows"))
    cells.forget()
    best = best_round(history)
    # the mean alone: one tree that counts for nothing
    return GBTRegressionModel(ensemble(spark, trees[:best], step) if best else ensemble(spark, trees[:1], 0.0)), history
