"""Regression trees on binned features, all folds grown in step.

Features are cut into bins once, from quantiles of each fold's training rows. A tree then grows level by level: sums of
gradients and weights by (fold, node, feature, bin), the best cut of each node, and on to the next level.

* Folds of many rows: one aggregation per level over all folds and, where trees do not depend on each other, over
  several trees. Tasks send sums per bin, never rows; only the cuts reach the driver.
* Folds that are counted to be small are sent whole to a task each (or to several, when trees do not depend on each
  other), which grows the same trees by the same rules without a job per level.

Samples are drawn by hashes of rows, so both ways, and reruns, draw alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.panel import need_columns
from chronopanel.session import materialize

# A fold of at most so many training rows is sent to one task: a byte per feature and some 30 bytes a row.
FOLD_ROWS = 1_000_000
# Trees after which the running predictions of a level-wise fit are stored, instead of made again from the trees.
STORE_EVERY = 20
# Sums (nodes x features x bins) of a tree's level that are looked at together.
CELLS = 1 << 22

NODES = "fold int, tree int, node int, left int, feature int, bin int, value double, gain double, weight double"
U64 = np.uint64


@dataclass(frozen=True)
class Growth:
    """``boosted``: each tree corrects those before it by ``step``; else trees are averaged, with ``bootstrap`` each on rows drawn with replacement."""

    trees: int
    depth: int
    bins: int = 256
    boosted: bool = True
    bootstrap: bool = True
    step: float = 0.05
    row_share: float = 1.0
    column_share: float = 1.0
    l2: float = 1.0
    min_leaf: float = 1.0
    seed: int = 42


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _uniform(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A number in [0, 1) per row hash, new for each tree."""
    key = _mix(np.array([tree * 1_000_003 + seed + 1], U64))
    return (_mix(h.view(U64) ^ key) >> U64(11)).astype(np.float64) / (1 << 53)


# Chances of a Poisson variable of mean 1 to be at most 0, 1, 2, ..
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 12.0)))))


def row_weights(h: np.ndarray, tree: int, how: Growth) -> np.ndarray:
    if not how.boosted and not how.bootstrap:
        return np.ones(len(h))
    u = _uniform(h, tree, how.seed)
    return (u < how.row_share).astype(np.float64) if how.boosted else np.searchsorted(_POISSON, u, side="right").astype(np.float64)


def columns_of(tree: int, n: int, how: Growth) -> np.ndarray:
    """The features that a tree may cut by."""
    take = max(1, round(how.column_share * n))
    draw = _uniform(_mix(np.arange(n, dtype=U64) + U64(1 << 40)).view(np.int64), tree, how.seed)
    return np.sort(np.argsort(draw, kind="stable")[:take])


def sums(x: np.ndarray, node: np.ndarray, g: np.ndarray, w: np.ndarray, n_nodes: int, columns: np.ndarray, bins: int) -> np.ndarray:
    """(2, nodes, columns, bins): gradients and weights, of rows whose node is not negative."""
    live = node >= 0
    x, node, g, w = x[live], node[live].astype(np.int64) * bins, g[live], w[live]
    out = np.empty((2, n_nodes, len(columns), bins))
    for k, c in enumerate(columns):
        cell = node + x[:, c]
        out[0, :, k] = np.bincount(cell, g, n_nodes * bins).reshape(n_nodes, bins)
        out[1, :, k] = np.bincount(cell, w, n_nodes * bins).reshape(n_nodes, bins)
    return out


def best_cuts(total: np.ndarray, how: Growth) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node: gain (0 where no cut is allowed), place of the column, last bin that goes left; the first of equals."""
    left = np.cumsum(total, axis=3)
    g, w = left[0, :, :1, -1:], left[1, :, :1, -1:]
    gl, wl = left[0], left[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (wl + how.l2) + (g - gl) ** 2 / (w - wl + how.l2) - g * g / (w + how.l2)
    # Weights are whole numbers; a cut must leave some on both sides.
    least = max(how.min_leaf, 0.5)
    gain[(wl < least) | (w - wl < least) | ~np.isfinite(gain)] = 0.0
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    return flat[np.arange(len(flat)), at], at // total.shape[3], at % total.shape[3]


class Tree:
    """Nodes in the order of levels; the right child follows the left one."""

    def __init__(self, columns: np.ndarray) -> None:
        self.columns = columns
        self.left, self.feature, self.bin, self.value, self.gain, self.weight = [-1], [0], [0], [0.0], [0.0], [0.0]
        self.level = np.array([0])  # nodes that are open

    def grow(self, total: np.ndarray, how: Growth, last: bool) -> None:
        """Closes the open nodes from their sums: a value for each, and a cut with two open nodes below where one pays."""
        g, w = total[0, :, 0].sum(axis=1), total[1, :, 0].sum(axis=1)
        gain, column, cut = best_cuts(total, how)
        below = []
        for k, node in enumerate(self.level.tolist()):
            self.value[node] = -g[k] / (w[k] + how.l2) if w[k] + how.l2 > 0 else 0.0
            self.weight[node] = w[k]
            if not last and gain[k] > 1e-12 * (1.0 + g[k] * g[k] / (w[k] + how.l2 + 1.0)):
                self.left[node], self.feature[node], self.bin[node], self.gain[node] = len(self.left), int(self.columns[column[k]]), int(cut[k]), float(gain[k])
                below += [len(self.left), len(self.left) + 1]
                for part, blank in ((self.left, -1), (self.feature, 0), (self.bin, 0), (self.value, 0.0), (self.gain, 0.0), (self.weight, 0.0)):
                    part += [blank, blank]
        self.level = np.array(below, np.int64)

    def down(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Each row's node, one level further where its node is cut."""
        left = np.array(self.left)[node]
        right = x[np.arange(len(x)), np.array(self.feature)[node]] > np.array(self.bin)[node]
        return np.where(left < 0, node, left + right)

    def place(self, node: np.ndarray) -> np.ndarray:
        """Number of each row's node among the open ones, or -1."""
        where = np.full(len(self.left), -1)
        where[self.level] = np.arange(len(self.level))
        return where[node]

    def values(self, x: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = self.down(x, node)
        return np.array(self.value)[node]

    def rows(self, fold: int, tree: int) -> pd.DataFrame:
        n = len(self.left)
        return pd.DataFrame({"fold": np.full(n, fold, np.int32), "tree": np.full(n, tree, np.int32), "node": np.arange(n, dtype=np.int32), "left": np.array(self.left, np.int32),
                             "feature": np.array(self.feature, np.int32), "bin": np.array(self.bin, np.int32), "value": self.value, "gain": self.gain, "weight": self.weight})


def grow_tree(x: np.ndarray, y: np.ndarray, running: np.ndarray, h: np.ndarray, number: int, how: Growth) -> Tree:
    """One tree from all rows of a fold."""
    tree = Tree(columns_of(number, x.shape[1], how))
    w = row_weights(h, number, how)
    g = (running - y) * w
    drawn = w > 0
    rows, node = x[drawn], np.zeros(int(drawn.sum()), np.int64)
    g, w = g[drawn], w[drawn]
    for level in range(how.depth + 1):
        parts = []
        # Many open nodes are summed some at a time.
        n, step = len(tree.level), max(1, CELLS // (len(tree.columns) * how.bins))
        place = tree.place(node)
        if level == how.depth:  # no cut below: sums over all bins do
            zero = np.zeros((len(rows), 1), np.uint8)
            tree.grow(sums(zero, place, g, w, n, np.array([0]), 1), how, True)
            break
        for at in range(0, n, step):
            mine = np.where((place >= at) & (place < at + step), place - at, -1)
            parts.append((at, mine))
        closed = tree.level
        below: list[int] = []
        for at, mine in parts:
            tree.level = closed[at : at + step]
            tree.grow(sums(rows, mine, g, w, len(tree.level), tree.columns, how.bins), how, False)
            below += tree.level.tolist()
        tree.level = np.array(below, np.int64)
        if not below:
            break
        node = tree.down(rows, node)
    return tree


# --- bins ---------------------------------------------------------------------------

def bin_edges(train: DataFrame, features: Sequence[str], bins: int) -> dict[int, list[np.ndarray]]:
    """Per fold and feature the upper edges of bins; a value goes to the first bin whose edge is not below it.

    All values are edges while a thousandth of the rows have each; else edges are evenly spread quantiles.
    """
    fine = 4 * bins
    # One expression instead of a thousand literals for each feature.
    probs = F.split(F.lit(",".join(str(i / fine) for i in range(1, fine + 1))), ",").cast("array<double>")
    found = train.groupBy("fold").agg(*[F.percentile_approx(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), probs, 10 * fine).alias(f"e{i}") for i, c in enumerate(features)]).collect()
    edges = {}
    for r in found:
        edges[r["fold"]] = []
        for i in range(len(features)):
            e = np.unique(np.array(r[f"e{i}"] if r[f"e{i}"] is not None else [0.0]))
            edges[r["fold"]].append(e if len(e) <= bins else e[np.linspace(0, len(e) - 1, bins).round().astype(int)])
    return edges


def _matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in features])


def binned_rows(train: DataFrame, target: str, features: Sequence[str], edges: dict) -> DataFrame:
    """(fold, h, y, x): a hash of the row, its target, and a byte per feature. What is missing goes to the lowest bin."""
    names = [f"f{i}" for i in range(len(features))]
    sent = train.sparkSession.sparkContext.broadcast(edges)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, fold = _matrix(batch, names), batch.column("fold").to_numpy()
            x = np.zeros(values.shape, np.uint8)
            for k in np.unique(fold):
                mine = fold == k
                for i, e in enumerate(sent.value[int(k)]):
                    v = values[mine, i]
                    x[mine, i] = np.where(np.isnan(v), 0, np.minimum(np.searchsorted(e, v), len(e) - 1))
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("h"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["fold", "h", "y", "x"])

    cols = [F.col(f"`{c}`").cast("double") for c in features]
    src = train.select("fold", F.xxhash64(*cols, F.col(f"`{target}`")).alias("h"), F.col(f"`{target}`").cast("double").alias("y"), *[c.alias(n) for c, n in zip(cols, names, strict=True)])
    return src.filter(F.col("y").isNotNull()).mapInArrow(cut, "fold int, h bigint, y double, x binary")


def _arrays(batch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, n)
    return x, batch.column("y").to_numpy(), batch.column("h").to_numpy()


# --- folds of few rows -------------------------------------------------------------------

def _whole_folds(rows: DataFrame, n_features: int, how: Growth, means: dict[int, float], parts: int) -> DataFrame:
    """Each fold's rows go to the tasks that grow its trees: one, or ``parts`` where trees do not depend on each other."""
    folds = sorted(means)
    place = {k: i * parts for i, k in enumerate(folds)}
    slot = F.element_at(F.create_map(*[F.lit(v) for kv in place.items() for v in kv]), F.col("fold"))
    dealt = rows.withColumn("slot", F.explode(F.array(*[slot + p for p in range(parts)]))).repartitionById(len(folds) * parts, F.col("slot"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        table = pa.Table.from_batches(got)
        slot_, fold = table.column("slot")[0].as_py(), table.column("fold")[0].as_py()
        x, y, h = _arrays(table, n_features)
        # Rows in one order, whatever order they came in, so that sums agree to the last bit.
        order = np.lexsort((y, h))
        x, y, h = x[order], y[order], h[order]
        running = np.full(len(y), means[fold] if how.boosted else 0.0)
        for t in range(slot_ - place[fold], how.trees, parts):
            tree = grow_tree(x, y, running, h, t, how)
            if how.boosted:
                running = running + how.step * tree.values(x, how.depth)
            yield pa.RecordBatch.from_pandas(tree.rows(fold, t), preserve_index=False)

    return dealt.select("slot", "fold", "h", "y", "x").mapInArrow(grow, NODES)


# --- folds of many rows ------------------------------------------------------------------

def _level_sums(rows: DataFrame, n_features: int, how: Growth, means: dict[int, float], before: dict, trees: dict, numbers: Sequence[int]) -> DataFrame:
    """(fold, tree, place, column, g, w): sums of the open nodes of ``trees`` ({(fold, number): Tree}); ``before``: trees since scores were stored."""
    sent = rows.sparkSession.sparkContext.broadcast((means, before, trees))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, before, trees = sent.value
        held: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            x_all, y_all, h_all = _arrays(batch, n_features)
            fold, score = batch.column("fold").to_numpy(), batch.column("score").to_numpy()
            for k in np.unique(fold).tolist():
                mine = fold == k
                x, y, h, running = x_all[mine], y_all[mine], h_all[mine], score[mine].copy()
                for t in before.get(k, ()):
                    running += how.step * t.values(x, how.depth)
                for number in numbers:
                    tree = trees[k, number]
                    if not len(tree.level):
                        continue
                    w = row_weights(h, number, how)
                    node = np.zeros(len(x), np.int64)
                    for _ in range(how.depth):
                        node = tree.down(x, node)
                    part = sums(x, np.where(w > 0, tree.place(node), -1), (running - y) * w, w, len(tree.level), tree.columns, how.bins)
                    held[k, number] = held[k, number] + part if (k, number) in held else part
        for (k, number), total in held.items():
            _, nodes, columns, _ = total.shape
            where = np.indices((nodes, columns)).reshape(2, -1)
            flat = total.reshape(2, nodes * columns, -1)
            n = nodes * columns
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(where[0].astype(np.int32)), pa.array(where[1].astype(np.int32)),
                 pa.array(list(flat[0]), pa.list_(pa.float64())), pa.array(list(flat[1]), pa.list_(pa.float64()))], names=["fold", "tree", "place", "column", "g", "w"])

    return rows.mapInArrow(add, "fold int, tree int, place int, column int, g array<double>, w array<double>")


def _cuts(level: DataFrame, how: Growth) -> DataFrame:
    """Per (fold, tree, place): sums of the node and its best cut. One row per bin is added up, so no node is gathered."""
    cells = level.select("fold", "tree", "place", "column", F.posexplode(F.arrays_zip("g", "w")).alias("bin", "s")).groupBy("fold", "tree", "place", "column", "bin").agg(
        F.sum("s.g").alias("g"), F.sum("s.w").alias("w"))
    per_column = cells.groupBy("fold", "tree", "place", "column").agg(F.array_sort(F.collect_list(F.struct("bin", "g", "w"))).alias("s"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            s = batch.column("s")
            total = np.stack([np.array(s.values.field(c)).reshape(len(batch), 1, how.bins) for c in ("g", "w")])
            gain, _, at = best_cuts(total, how)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("fold", "tree", "place", "column")), pa.array(total[0].sum(axis=(1, 2))), pa.array(total[1].sum(axis=(1, 2))), pa.array(gain), pa.array(at.astype(np.int32))],
                names=["fold", "tree", "place", "column", "g", "w", "gain", "bin"])

    best = per_column.mapInArrow(cut, "fold int, tree int, place int, column int, g double, w double, gain double, bin int")
    return best.groupBy("fold", "tree", "place").agg(F.max_by(F.struct("column", "bin", "gain", "g", "w"), F.struct("gain", -F.col("column"))).alias("c")).select("fold", "tree", "place", "c.*")


def _by_levels(rows: DataFrame, n_features: int, how: Growth, means: dict[int, float]) -> DataFrame:
    """All folds in step: a job per level, over one tree of each fold, or over several where trees do not depend on each other."""
    spark = rows.sparkSession
    start = F.element_at(F.create_map(*[F.lit(v) for kv in means.items() for v in kv]), F.col("fold")) if how.boosted else F.lit(0.0)
    rows = materialize(rows.withColumn("score", start))
    before: dict[int, list[Tree]] = {k: [] for k in means}
    done = []
    at_once = 1 if how.boosted else max(1, CELLS // (n_features * how.bins << min(how.depth, 10)))
    for first in range(0, how.trees, at_once):
        numbers = list(range(first, min(first + at_once, how.trees)))
        trees = {(k, t): Tree(columns_of(t, n_features, how)) for k in means for t in numbers}
        for level in range(how.depth + 1):
            found = _cuts(_level_sums(rows, n_features, how, means, before, trees, numbers), how).collect()
            for (k, t), tree in trees.items():
                mine = sorted((r for r in found if (r["fold"], r["tree"]) == (k, t)), key=lambda r: r["place"])
                _close(tree, mine, how, level == how.depth)
            if not any(len(t.level) for t in trees.values()):
                break
        done += [tree.rows(k, t) for (k, t), tree in trees.items()]
        if how.boosted:
            for (k, _), tree in trees.items():
                before[k].append(tree)
            if len(before[next(iter(means))]) >= STORE_EVERY:
                rows, before = materialize(_scored(rows, n_features, how, before)), {k: [] for k in means}
    return spark.createDataFrame(pd.concat(done, ignore_index=True), NODES)


def _close(tree: Tree, cuts: list, how: Growth, last: bool) -> None:
    """As `Tree.grow`, from cuts that tasks found. A node without rows closes with nothing."""
    by_place = {r["place"]: r for r in cuts}
    below: list[int] = []
    for place, node in enumerate(tree.level.tolist()):
        r = by_place.get(place)
        if r is None:
            continue
        g, w = r["g"], r["w"]
        tree.value[node], tree.weight[node] = (-g / (w + how.l2) if w + how.l2 > 0 else 0.0), w
        if not last and r["gain"] > 1e-12 * (1.0 + g * g / (w + how.l2 + 1.0)):
            tree.left[node], tree.feature[node], tree.bin[node], tree.gain[node] = len(tree.left), int(tree.columns[r["column"]]), r["bin"], r["gain"]
            below += [len(tree.left), len(tree.left) + 1]
            for part, blank in ((tree.left, -1), (tree.feature, 0), (tree.bin, 0), (tree.value, 0.0), (tree.gain, 0.0), (tree.weight, 0.0)):
                part += [blank, blank]
    tree.level = np.array(below, np.int64)


def _scored(rows: DataFrame, n_features: int, how: Growth, before: dict) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(before)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, _, _ = _arrays(batch, n_features)
            fold, score = batch.column("fold").to_numpy(), batch.column("score").to_numpy().copy()
            for k in np.unique(fold).tolist():
                mine = fold == k
                for t in sent.value[k]:
                    score[mine] += how.step * t.values(x[mine], how.depth)
            yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(score))

    return rows.mapInArrow(add, rows.schema)


# --- ensembles -----------------------------------------------------------------------------

@dataclass
class Ensemble:
    """Fitted trees of all folds: ``nodes`` as a table, the bin edges, and each fold's mean target."""

    nodes: DataFrame
    edges: dict[int, list[np.ndarray]]
    means: dict[int, float]
    features: list[str]
    how: Growth

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with their fold) and ``y_pred``; null where the fold has no trees. A fold's trees are sent to the tasks."""
        need_columns(rows, ["fold", *self.features])
        how, names = self.how, [f"__f{i}" for i in range(len(self.features))]
        table = self.nodes.orderBy("fold", "tree", "node").toPandas()
        packed = {}
        for k, part in table.groupby("fold"):
            edges = self.edges[int(k)]
            roots = np.flatnonzero(part["node"].to_numpy() == 0)
            base = np.repeat(roots, np.diff(np.append(roots, len(part))))
            left = part["left"].to_numpy()
            cut = np.array([edges[f][min(b, len(edges[f]) - 1)] for f, b in zip(part["feature"], part["bin"], strict=True)])
            packed[int(k)] = (roots, np.where(left < 0, -1, left + base), part["feature"].to_numpy(), cut, part["value"].to_numpy())
        sent = rows.sparkSession.sparkContext.broadcast((packed, self.means))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packed, means = sent.value
            for batch in batches:
                x, fold = np.nan_to_num(_matrix(batch, names), nan=-np.inf), batch.column("fold").to_numpy()
                out = np.full(len(batch), np.nan)
                for k in np.unique(fold).tolist():
                    if k not in packed:
                        continue
                    roots, left, feature, cut, value = packed[k]
                    for at in range(0, len(batch), 1000):
                        mine = np.flatnonzero(fold[at : at + 1000] == k) + at
                        node = np.tile(roots, (len(mine), 1))
                        for _ in range(how.depth):
                            down = left[node]
                            right = x[mine[:, None], feature[node]] > cut[node]
                            node = np.where(down < 0, node, down + right)
                        total = value[node].sum(axis=1)
                        out[mine] = means[k] + how.step * total if how.boosted else total / len(roots)
                rest = [c for c in batch.schema.names if c not in names]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, from_pandas=True)], names=[*rest, "y_pred"])

        src = rows.select("*", *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(self.features, names, strict=True)])
        schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        return src.mapInArrow(run, f"{schema}, y_pred double")

    def thresholds(self) -> DataFrame:
        """The nodes with the name of the feature and the value up to which rows go left; both null for leaves."""
        rows = [(int(k), i, b, f, float(e)) for k, cuts in self.edges.items() for i, (f, es) in enumerate(zip(self.features, cuts, strict=True)) for b, e in enumerate(es)]
        named = self.nodes.sparkSession.createDataFrame(rows, "fold int, feature int, bin int, name string, threshold double")
        inner = F.col("left") >= 0
        joined = self.nodes.join(named, ["fold", "feature", "bin"], "left")
        return joined.withColumns({c: F.when(inner, F.col(c)) for c in ("name", "threshold")})

    def importances(self) -> DataFrame:
        """(fold, feature, importance): gain per cut of boosted trees, whole gain of averaged ones; they add up to 1 in a fold. Unused features have 0."""
        spark = self.nodes.sparkSession
        gain = F.avg("gain") if self.how.boosted else F.sum("gain")
        used = self.nodes.filter("left >= 0").groupBy("fold", F.col("feature").alias("i")).agg(gain.alias("gain"))
        names = spark.createDataFrame([(int(k), i, f) for k in self.means for i, f in enumerate(self.features)], "fold int, i int, feature string")
        whole = used.groupBy("fold").agg(F.sum("gain").alias("whole"))
        joined = names.join(used, ["fold", "i"], "left").join(whole, "fold", "left")
        return joined.select("fold", "feature", F.coalesce(F.col("gain") / F.col("whole"), F.lit(0.0)).alias("importance"))


def grow_folds(train: DataFrame, target: str, features: Sequence[str], how: Growth, fold_rows: int = FOLD_ROWS) -> Ensemble:
    """Trees of every fold in ``train`` (with a column fold). Rows without a target are left out; a missing feature counts as the lowest value."""
    features = list(features)
    need_columns(train, ["fold", target, *features])
    if not 2 <= how.bins <= 256:
        raise ValueError("between 2 and 256 bins")
    train = train.withColumn("fold", F.col("fold").cast("int"))
    edges = bin_edges(train, features, how.bins)
    rows = materialize(binned_rows(train, target, features, edges))
    sizes = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).collect()}
    means = {k: r["mean"] for k, r in sorted(sizes.items())}
    if not means:
        return Ensemble(train.sparkSession.createDataFrame([], NODES), edges, means, features, how)
    if max(r["n"] for r in sizes.values()) <= fold_rows:
        parts = 1 if how.boosted else max(1, min(how.trees, 2 * train.sparkSession.sparkContext.defaultParallelism // len(means)))
        nodes = materialize(_whole_folds(rows, len(features), how, means, parts))
    else:
        nodes = materialize(_by_levels(rows, len(features), how, means))
    return Ensemble(nodes, edges, means, features, how)
