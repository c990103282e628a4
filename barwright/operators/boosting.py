"""Gradient boosting of many models at once by histograms.

A model is a group of rows (a fold of a run) and a learner; the trees of all models, and of all classes or targets inside them, grow side by
side. A round is one aggregate per level: every task adds up gradients per (group, learner, output, node, feature, bin), the sums of one output of
one model meet in one task that chooses its splits, and the leaves follow from the sums of the last level. Jobs grow with rounds and depth, not
with models, and what the driver sees is splits, never histograms or rows. Rounds end for a model when its loss on the rows held out for stopping has not improved for a while.

Three learners differ in how they grow: `levelwise` splits every node by itself, `sampled` does so on a hashed four fifths of the rows of each
round, `symmetric` gives all nodes of a level one split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from barwright.session import ensure_checkpoint_dir

LEARNERS = ("levelwise", "sampled", "symmetric")
# Fixed values of the recipe: rounds, depth, step, rounds without improvement.
ROUNDS, DEPTH, STEP, PATIENCE = 240, 3, 0.035, 20
BINS, RIDGE, LEAST_WEIGHT, SHARE = 32, 1.0, 1.0, 0.8
# Rounds after which rows carry their scores, so that a job evaluates no more trees than these.
EVERY = 20
FIT, STOP = 0, 1
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Booster:
    """Trees of all models: arrays over (round, group, learner, output, node or leaf), and what the rounds did."""
    kind: str                      # "classes" or "targets"
    edges: np.ndarray              # group x feature x (BINS - 1)
    base: np.ndarray               # group x output
    feature: np.ndarray            # round x group x learner x output x (2 ** DEPTH - 1); -1: no split, all rows go left
    cut: np.ndarray                # rows whose bin is above go right
    leaf: np.ndarray               # round x group x learner x output x 2 ** DEPTH
    gain: np.ndarray               # group x learner x feature
    loss: np.ndarray               # round x group x learner: on the rows held out, before that round
    used: np.ndarray               # group x learner: rounds that count

    def importance(self) -> np.ndarray:
        total = self.gain.sum(axis=2, keepdims=True)
        return self.gain / np.where(total > 0, total, 1)


def binned(values: np.ndarray, group: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of every feature: how many edges of the row's group lie below the value."""
    return (values[:, :, None] > edges[group]).sum(axis=2).astype(np.int16)


def node_of(bins: np.ndarray, group: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Node of `depth` that each row reaches, for trees given as group x node arrays."""
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for level in range(depth):
        at = (1 << level) - 1 + node
        f = feature[group, at]
        node = 2 * node + ((f >= 0) & (bins[rows, np.maximum(f, 0)] > cut[group, at]))
    return node


def advanced(score: np.ndarray, bins: np.ndarray, group: np.ndarray, trees: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Scores (row x learner x output) after some rounds of trees."""
    score = score.copy()
    for feature, cut, leaf in trees:
        for l in range(score.shape[1]):
            for k in range(score.shape[2]):
                score[:, l, k] += leaf[:, l, k][group, node_of(bins, group, feature[:, l, k], cut[:, l, k], DEPTH)]
    return score


def probabilities(score: np.ndarray) -> np.ndarray:
    high = np.exp(score - score.max(axis=-1, keepdims=True))
    return high / high.sum(axis=-1, keepdims=True)


def blocks_of(df: DataFrame, features: Sequence[str], targets: Sequence[str], edges: np.ndarray, base: np.ndarray, group: str, part: str, key: str) -> RDD:
    """(group, part, bins, targets, hash of the key, scores) of all rows, some thousand rows a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, p, mark = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            x, y = (batch.column(i).flatten().to_numpy().astype(np.float64).reshape(len(g), -1) for i in (3, 4))
            score = np.repeat(base[g][:, None, :], len(LEARNERS), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([column.tobytes()], pa.binary()) for column in (g, p, binned(x, g, edges), y, mark, score)], names=list("gpxyms"))

    def opened(row) -> Rows:
        g, p, m = (np.frombuffer(row[c], np.int64) for c in "gpm")
        n = len(g)
        return g, p, np.frombuffer(row["x"], np.int16).reshape(n, -1), np.frombuffer(row["y"], np.float64).reshape(n, -1), m, np.frombuffer(row["s"], np.float64).reshape(n, len(LEARNERS), -1)

    def column(name: str):
        return F.col(name).cast("double")
    rows = df.select(F.col(group).cast("bigint"), F.col(part).cast("bigint"), F.xxhash64(key).alias("mark"), F.array(*map(column, features)), F.array(*map(column, targets)))
    return rows.mapInArrow(run, ", ".join(f"{c} binary" for c in "gpxyms")).rdd.map(opened)


def kept(rdd: RDD, before: RDD | None = None) -> RDD:
    """Computed once, in the shared folder, so that a lost executor costs no rounds."""
    rdd.persist(StorageLevel.MEMORY_AND_DISK)
    rdd.checkpoint()
    rdd.count()
    if before is not None:
        before.unpersist()
    return rdd


def added(rdd: RDD) -> np.ndarray | tuple:
    def both(a, b):
        return tuple(x + y for x, y in zip(a, b))
    return rdd.treeReduce(both) if rdd.getNumPartitions() > 32 else rdd.reduce(both)


def best_splits(sums: np.ndarray, alike: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, gain, left sums, right sums) per node, for one output of one model; sums are 2 x node x feature x bin."""
    left = np.cumsum(sums, axis=-1)
    total = left[..., -1:]
    right = total - left

    def worth(part: np.ndarray) -> np.ndarray:
        return part[0] ** 2 / (part[1] + RIDGE)
    gain = worth(left) + worth(right) - worth(total)
    gain = np.where((left[1] >= LEAST_WEIGHT) & (right[1] >= LEAST_WEIGHT), gain, 0.0)
    gain[..., -1] = 0
    flat = gain.reshape(len(gain), -1)
    if alike:
        # One split for all nodes of a level of the symmetric learner: the one of the largest gain in sum.
        flat = np.broadcast_to(np.where(flat >= 0, flat, 0).sum(axis=0, keepdims=True), flat.shape)
    chosen = flat.argmax(axis=-1)
    won = np.take_along_axis(flat, chosen[..., None], axis=-1)[..., 0]
    feature, cut = np.divmod(chosen, BINS)
    feature = np.where(won > 1e-12, feature, -1)

    def at(part: np.ndarray) -> np.ndarray:
        return np.take_along_axis(part.reshape(*part.shape[:-2], -1), np.broadcast_to(chosen, part.shape[:-2])[..., None], axis=-1)[..., 0]
    none = feature < 0
    return feature, cut, np.maximum(won, 0), np.where(none, total[..., 0, 0], at(left)), np.where(none, 0.0, at(right))


def level_splits(state: RDD, kind: str, groups: int, outputs: int, features: int, depth: int, number: int, trees: list, current: tuple[np.ndarray, np.ndarray]) -> tuple[list, np.ndarray, np.ndarray]:
    """([(group, learner, output), what `best_splits` says] of all groups with rows; loss and number of the rows held out per group and learner, at depth 0).

    The sums of one output of one model meet in one task, which adds them up in the order of the partitions and chooses the splits there: the driver
    receives splits, never sums.
    """
    nodes = 1 << depth

    def run(place: int, blocks: Iterator[Rows]) -> Iterator[tuple[tuple, tuple]]:
        sums = np.zeros((2, len(LEARNERS), outputs, features, groups * nodes * BINS))
        loss, count, seen = np.zeros((groups, len(LEARNERS))), np.zeros(groups), np.zeros(groups, bool)
        for g, p, x, y, mark, before in blocks:
            score = advanced(before, x, g, trees)
            if kind == "classes":
                chance = probabilities(score)
                hit = (y[:, :1] == np.arange(outputs))[:, None, :]
                slope, weight = chance - hit, chance * (1 - chance)
                lost = -np.log(np.maximum((chance * hit).sum(axis=2), 1e-15))
            else:
                slope = score - y[:, None, :]
                weight, lost = np.ones_like(slope), (slope ** 2).sum(axis=2)
            held = p == STOP
            np.add.at(loss, g[held], lost[held])
            np.add.at(count, g[held], 1)
            seen[g] = True
            # A hash of row and round draws the rows of the sampled learner.
            with np.errstate(over="ignore"):
                drawn = ((mark ^ (number * 0x9E3779B9)) * 0x9E3779B1 >> 16 & 0xFFFF) < SHARE * 0x10000
            for l, name in enumerate(LEARNERS):
                use = np.flatnonzero((p == FIT) & (drawn if name == "sampled" else True))
                own, bins = g[use], x[use]
                for k in range(outputs):
                    node = own * nodes + node_of(bins, own, current[0][:, l, k], current[1][:, l, k], depth)
                    for f in range(features):
                        at = node * BINS + bins[:, f]
                        for i, value in enumerate((slope, weight)):
                            sums[i, l, k, f] += np.bincount(at, value[use, l, k], minlength=groups * nodes * BINS)
        sums = sums.reshape(2, len(LEARNERS), outputs, features, groups, nodes, BINS)
        for g in np.flatnonzero(seen).tolist():
            for l in range(len(LEARNERS)):
                for k in range(outputs):
                    yield (g, l, k), (place, sums[:, l, k, :, g].transpose(0, 2, 1, 3).copy(), loss[g, l], count[g])

    def chosen(item: tuple[tuple, Iterable]) -> tuple:
        (g, l, k), parts = item
        parts = sorted(parts, key=lambda part: part[0])
        total, loss, count = parts[0][1:]
        for _, sums, lost, rows in parts[1:]:
            total, loss, count = total + sums, loss + lost, count + rows
        return (g, l, k), best_splits(total, LEARNERS[l] == "symmetric"), loss, count

    tasks = max(1, min(state.getNumPartitions(), groups))
    found = state.mapPartitionsWithIndex(run).groupByKey(tasks).map(chosen).collect()
    loss, count = np.zeros((groups, len(LEARNERS))), np.zeros((groups, 1))
    for (g, l, _), _, lost, rows in found:
        loss[g, l], count[g, 0] = lost, rows
    return [(key, splits) for key, splits, _, _ in found], loss, count


def train(df: DataFrame, features: Sequence[str], targets: Sequence[str], groups: int, kind: str = "classes", classes: int = 3, rounds: int = ROUNDS,
          group: str = "group", part: str = "part_code", key: str = "id") -> Booster:
    """Boost all groups (0 .. groups - 1) of df. `part` is FIT or STOP; features must not be missing.

    kind "classes": targets holds one column with class numbers. kind "targets": every column is a number to predict.
    """
    ensure_checkpoint_dir(df.sparkSession)
    outputs, width = (classes if kind == "classes" else len(targets)), len(features)
    fit = df.where(F.col(part) == FIT)
    said = fit.groupBy(group).agg(*[F.percentile_approx(F.col(f).cast("double"), [i / BINS for i in range(1, BINS)], 10_000).alias(f"e{i}") for i, f in enumerate(features)],
                                  *([F.avg((F.col(targets[0]) == k).cast("double")).alias(f"b{k}") for k in range(outputs)] if kind == "classes" else [F.avg(F.col(c).cast("double")).alias(f"b{k}") for k, c in enumerate(targets)])).collect()
    edges, base = np.full((groups, width, BINS - 1), np.inf), np.zeros((groups, outputs))
    for row in said:
        edges[row[group]] = [row[f"e{i}"] for i in range(width)]
        base[row[group]] = [row[f"b{k}"] for k in range(outputs)]
    if kind == "classes":
        base = np.log(np.maximum(base, 1e-3))
    state = kept(blocks_of(df.where(F.col(part).isin(FIT, STOP)), features, targets, edges, base, group, part, key))
    shape = (groups, len(LEARNERS), outputs)
    trees, recent, losses = [], [], []
    gain_of = np.zeros((groups, len(LEARNERS), width))
    best, used = np.full(shape[:2], np.inf), np.zeros(shape[:2], np.int64)
    growing = np.ones(shape[:2], bool)
    for number in range(rounds + 1):
        feature, cut = np.full((*shape, (1 << DEPTH) - 1), -1, np.int64), np.zeros((*shape, (1 << DEPTH) - 1), np.int64)
        for depth in range(DEPTH if number < rounds else 1):
            found, loss, count = level_splits(state, kind, groups, outputs, width, depth, number, recent, (feature, cut))
            if depth == 0:
                now = loss / np.maximum(count, 1)
                losses.append(now)
                better = growing & (now < best - 1e-9)
                best, used = np.where(better, now, best), np.where(better, number, used)
                growing &= number - used < PATIENCE
            if number == rounds:
                break
            f, c = np.full((*shape, 1 << depth), -1, np.int64), np.zeros((*shape, 1 << depth), np.int64)
            gain, left, right = np.zeros(f.shape), np.zeros((2, *f.shape)), np.zeros((2, *f.shape))
            for at, splits in found:
                f[at], c[at], gain[at], left[:, *at], right[:, *at] = splits
            f = np.where(growing[:, :, None, None], f, -1)
            at = slice((1 << depth) - 1, (1 << depth + 1) - 1)
            feature[..., at], cut[..., at] = f, c
            for i in range(width):
                gain_of[..., i] += np.where(f == i, gain, 0).sum(axis=(2, 3))
        if number == rounds or not growing.any():
            break
        value = -STEP * np.stack([left[0] / (left[1] + RIDGE), right[0] / (right[1] + RIDGE)], axis=-1).reshape(*shape, 1 << DEPTH)
        leaf = np.where(growing[:, :, None, None], value, 0.0)
        trees.append((feature, cut, leaf))
        recent = [*recent, trees[-1]]
        if len(recent) == EVERY:
            def carry(blocks: Iterator[Rows], some: list = recent) -> Iterator[Rows]:
                for g, p, x, y, mark, score in blocks:
                    yield g, p, x, y, mark, advanced(score, x, g, some)
            state, recent = kept(state.mapPartitions(carry), state), []
    state.unpersist()
    empty = np.zeros((0, *shape, 1))
    feature, cut, leaf = (np.stack([tree[i] for tree in trees]) if trees else empty for i in range(3))
    # Rounds after the best one do not count.
    leaf = leaf * (np.arange(len(trees))[:, None, None] < used)[..., None, None] if trees else leaf
    return Booster(kind, edges, base, feature, cut, leaf, gain_of, np.stack(losses), used)


def predict(df: DataFrame, booster: Booster, features: Sequence[str], keep: Sequence[str], group: str = "group") -> DataFrame:
    """Rows (*keep, learner, score): probabilities of the classes, or predictions of the targets; one row per input row and learner."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = list(zip(booster.feature, booster.cut, booster.leaf))
        for batch in batches:
            g = batch.column(0).to_numpy().astype(np.int64)
            if not len(g):
                continue
            x = batch.column(1).flatten().to_numpy().reshape(len(g), -1)
            score = advanced(np.repeat(booster.base[g][:, None, :], len(LEARNERS), axis=1), binned(x, g, booster.edges), g, trees)
            score = probabilities(score) if booster.kind == "classes" else score
            for l, name in enumerate(LEARNERS):
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array([name] * len(g)), pa.array(list(score[:, l]), pa.list_(pa.float64()))], names=[*keep, "learner", "score"])

    rows = df.select(F.col(group).cast("bigint").alias("_g"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), *keep)
    return rows.mapInArrow(run, ", ".join(f"`{name}` {df.schema[name].dataType.simpleString()}" for name in keep) + ", learner string, score array<double>")


def calibrators(df: DataFrame, models: int, classes: int, model: str = "model", score: str = "score", label: str = "label", steps: int = 12, ridge: float = 1e-3) -> np.ndarray:
    """Multinomial logistic calibrators (model x class x (1 + class)) on the scores, by Newton steps: one aggregate per step for all models."""
    size = classes * (classes + 1)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0).to_numpy().astype(np.int64), batch.column(1).flatten().to_numpy(), batch.column(2).to_numpy().astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([column.tobytes()], pa.binary()) for column in columns], names=list("mxy"))

    rows = df.select(F.col(model).cast("bigint"), score, F.col(label).cast("bigint")).mapInArrow(opened, "m binary, x binary, y binary").rdd
    rows = kept(rows.map(lambda r: (np.frombuffer(r["m"], np.int64), np.frombuffer(r["x"], np.float64).reshape(-1, classes), np.frombuffer(r["y"], np.int64))))
    weights = np.zeros((models, classes, classes + 1))
    for _ in range(steps):
        def run(blocks: Iterator[tuple], weights: np.ndarray = weights) -> Iterator[tuple]:
            slope, bend, count = np.zeros((models, size)), np.zeros((models, size, size)), np.zeros((models, 1))
            for m, x, y in blocks:
                full = np.hstack([np.ones((len(x), 1)), x])
                chance = probabilities(np.einsum("nkj,nj->nk", weights[m], full))
                error = chance - (y[:, None] == np.arange(classes))
                inner = chance[:, :, None] * (np.eye(classes)[None] - chance[:, None, :])
                each = np.einsum("nkl,ni,nj->nkilj", inner, full, full).reshape(len(x), size, size)
                np.add.at(slope, m, (error[:, :, None] * full[:, None, :]).reshape(len(x), size))
                np.add.at(bend, m, each)
                np.add.at(count, m, 1)
            yield slope, bend, count

        slope, bend, count = added(rows.mapPartitions(run))
        n = np.maximum(count, 1)
        slope = slope / n + ridge * weights.reshape(models, size)
        bend = bend / n[:, :, None] + ridge * np.eye(size)
        weights = weights - np.linalg.solve(bend, slope[:, :, None])[:, :, 0].reshape(weights.shape)
    rows.unpersist()
    return weights


def calibrated(df: DataFrame, weights: np.ndarray, model: str = "model", score: str = "score", name: str = "p") -> DataFrame:
    """df with the calibrated probabilities of its model; a model without calibration rows gives equal chances."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in one]) for one in weights])
    own = F.get(table, F.col(model).cast("int"))
    raised = F.transform(own, lambda row: F.exp(F.aggregate(F.arrays_zip(F.slice(row, 2, weights.shape[2] - 1).alias("w"), F.col(score).alias("x")), F.get(row, 0), lambda sum_, pair: sum_ + pair["w"] * pair["x"])))
    total = F.aggregate("_raised", F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("_raised", raised).withColumn(name, F.transform("_raised", lambda x: x / total)).drop("_raised")
