"""Exact decision trees, grown level by level; any number of trees in the same jobs.

Where a row stands in a tree follows from the splits made so far, so a level reads the rows as they are: tasks send each
row down the trees and give (node, feature, value) with its statistics, which are added up per distinct value. These sums
are range-partitioned by (node, feature, value); every task runs along its own range, and what lies in earlier ranges of
the same node and feature is added from a small table of range totals (a prefix scan). So no task holds more than its
range, however many values a feature has. The best cut of each node is chosen by aggregates, and one row a node comes to
the driver.

A node of at most local_cells numbers is finished by one task. Sums, cuts, ties and the features drawn at a node (a hash
of the tree's key, the node's place and the feature) are the same either way, so the size of a table never changes a tree.

A row's statistics are its weight by class, or its weight, weighted target and weighted square.
"""

from __future__ import annotations

import hashlib
import math
import numbers
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.base import Estimator, check_frame, check_is_fitted, check_random_state, classes_of
from quillon.functions.held import Held
from quillon.functions.stats import matrix

TOLERANCE = 1e-12
#: Gains count as equal when they agree to so many decimals (of the parent's impurity, for a variance).
DIGITS = 11
#: One task finishes a node of up to so many numbers (rows times features).
LOCAL_CELLS = 2_000_000
#: Rows wait in a task until they hold so many numbers; then their equal values are added up and sent.
WAITING = 4_000_000


def impurity(stats: np.ndarray, criterion: str) -> np.ndarray:
    """Of stats (..., m): gini or entropy (bits) of class weights, or the variance; 0 for no weight."""
    if criterion == "squared_error":
        w = stats[..., 0]
        safe = np.where(w > 0, w, 1)
        return np.where(w > 0, np.maximum(stats[..., 2] / safe - (stats[..., 1] / safe) ** 2, 0), 0)
    w = stats.sum(-1, keepdims=True)
    p = stats / np.where(w > 0, w, 1)
    if criterion == "gini":
        return np.where(w[..., 0] > 0, 1 - (p**2).sum(-1), 0)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)


def _impurity_column(s: list[Column], criterion: str) -> Column:
    if criterion == "squared_error":
        return F.when(s[0] > 0, F.greatest(s[2] / s[0] - (s[1] / s[0]) * (s[1] / s[0]), F.lit(0.0))).otherwise(0.0)
    w = sum(s[1:], s[0])
    if criterion == "gini":
        return F.when(w > 0, 1 - sum(((c / w) * (c / w) for c in s[1:]), (s[0] / w) * (s[0] / w))).otherwise(0.0)
    part = [F.when(c > 0, -(c / w) * F.log2(c / w)).otherwise(0.0) for c in s]
    return F.when(w > 0, sum(part[1:], part[0])).otherwise(0.0)


def resolve_max_features(max_features, d: int) -> int:
    """The number of features tried at a node: all of d, a named function of d, a count up to d, or a share up to 1 of d."""
    if max_features is None or isinstance(max_features, str):
        named = {None: d, "sqrt": math.isqrt(d), "log2": d.bit_length() - 1}
        if max_features in named:
            return max(1, named[max_features])
    elif isinstance(max_features, numbers.Real) and not isinstance(max_features, bool):
        whole = isinstance(max_features, numbers.Integral)
        if 0 < max_features <= (d if whole else 1):
            return max(1, math.floor(max_features if whole else max_features * d))
    raise ValueError(f"max_features is None, 'sqrt', 'log2', a count up to {d} or a share up to 1, not {max_features!r}")


def descend(arrays: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf of each row in a tree given by its features, thresholds and children."""
    feature, threshold, left, right = arrays
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return at
        own = at[inner]
        at[inner] = np.where(x[inner, feature[own]] <= threshold[own], left[own], right[own])


@dataclass
class Tree:
    """Nodes by number: feature (-1 in a leaf), threshold, children, statistics, rows."""

    criterion: str
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    stats: list = field(default_factory=list)
    rows: list = field(default_factory=list)
    depth: list = field(default_factory=list)
    place: list = field(default_factory=list)
    value: np.ndarray | None = None

    def add(self, stats, rows, depth: int = 0, place: int = 1) -> int:
        """A new leaf's number. place is 1 at the root, and twice its parent's on the left, one more on the right."""
        for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.stats, np.asarray(stats, float)), (self.rows, int(round(rows))), (self.depth, depth), (self.place, place)):
            column.append(v)
        return len(self.feature) - 1

    def split(self, k: int, cut: dict) -> tuple[int, int]:
        """Give leaf k two children by a cut (f, cut, left, n_left)."""
        left = np.asarray(cut["left"], float)
        self.feature[k], self.threshold[k] = int(cut["f"]), float(cut["cut"])
        self.left[k] = self.add(left, cut["n_left"], self.depth[k] + 1, 2 * self.place[k])
        self.right[k] = self.add(self.stats[k] - left, self.rows[k] - cut["n_left"], self.depth[k] + 1, 2 * self.place[k] + 1)
        return self.left[k], self.right[k]

    def graft(self, k: int, below: Tree) -> None:
        """Put another tree, grown from leaf k's rows, in its place."""
        number = {0: k}
        for j in range(len(below.feature)):
            if below.feature[j] >= 0:
                for child in (below.left[j], below.right[j]):
                    number[child] = self.add(below.stats[child], below.rows[child], below.depth[child], below.place[child])
                own = number[j]
                self.feature[own], self.threshold[own], self.left[own], self.right[own] = below.feature[j], below.threshold[j], number[below.left[j]], number[below.right[j]]

    def freeze(self) -> Tree:
        """Fix the nodes' values: mean targets or class shares (of no row at all, zero or equal shares)."""
        stats = np.array(self.stats)
        weight = _weight(stats, self.criterion)[:, None]
        none = np.zeros(1) if self.criterion == "squared_error" else np.full(stats.shape[1], 1 / stats.shape[1])
        self.value = np.where(weight > 0, (stats[:, 1:2] if self.criterion == "squared_error" else stats) / np.where(weight > 0, weight, 1), none)
        return self

    def arrays(self) -> tuple:
        return tuple(np.asarray(c) for c in (self.feature, self.threshold, self.left, self.right))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        return descend(self.arrays(), x)

    def importances(self, d: int) -> np.ndarray:
        out = np.zeros(d)
        weight = lambda s: s[0] if self.criterion == "squared_error" else s.sum()
        for k, f in enumerate(self.feature):
            if f >= 0:
                own, a, b = self.stats[k], self.stats[self.left[k]], self.stats[self.right[k]]
                out[f] += weight(own) * impurity(own, self.criterion) - weight(a) * impurity(a, self.criterion) - weight(b) * impurity(b, self.criterion)
        return out / out.sum() if out.sum() > 0 else out

    def to_rows(self) -> list[tuple]:
        return [(k, int(self.feature[k]), float(self.threshold[k]), int(self.left[k]), int(self.right[k]), self.value[k].tolist(), float(impurity(self.stats[k], self.criterion)), self.rows[k]) for k in range(len(self.feature))]


@dataclass(frozen=True)
class Rules:
    criterion: str = "gini"
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    min_impurity_decrease: float = 0.0
    max_features: object = None

    def check(self) -> None:
        if self.max_depth is not None and self.max_depth < 1 or self.min_samples_split < 2 or self.min_samples_leaf < 1 or self.min_impurity_decrease < 0:
            raise ValueError("bad tree limits")

    def may_split(self, stats, rows, depth) -> bool:
        return (self.max_depth is None or depth < self.max_depth) and rows >= self.min_samples_split and impurity(stats, self.criterion) > 0


def drawn(key: str, place: int, d: int) -> list[int]:
    """All features in the order in which a node tries them, by hashes of the tree's key, its place and the feature."""
    return sorted(range(d), key=lambda f: (hashlib.md5(f"{key}:{place}:{f}".encode()).hexdigest(), f))


def _weight(stats: np.ndarray, criterion: str):
    return stats[..., 0] if criterion == "squared_error" else stats.sum(-1)


def _scale(stats: np.ndarray, criterion: str) -> float:
    """The unit of a node's gains: its impurity where that is a variance."""
    return float(impurity(stats, criterion)) if criterion == "squared_error" else 1.0


def best_of(cands: list[dict], scale: float) -> dict | None:
    """Among the best cuts of a node's features: in index order, a later feature must gain more by the tolerance."""
    best, slack = None, TOLERANCE * scale
    for c in cands:
        if c["gain"] > slack and (best is None or c["gain"] > best["gain"] + slack):
            best = c
    return best


def grow_local(x: np.ndarray, s: np.ndarray, rules: Rules, key: str = "", times: np.ndarray | None = None, whole: float | None = None, depth: int = 0, place: int = 1) -> Tree:
    """A tree, or the part of one from some node on, from arrays in one process. times: as how many rows each row counts."""
    rules.check()
    tree, d = Tree(rules.criterion), x.shape[1]
    times = np.ones(len(x)) if times is None else times
    whole = float(_weight(s.sum(0), rules.criterion)) if whole is None else whole
    most = resolve_max_features(rules.max_features, d)
    stack = [(tree.add(s.sum(0), times.sum(), depth, place), np.arange(len(x)))]
    while stack:
        k, own = stack.pop()
        if not rules.may_split(tree.stats[k], tree.rows[k], tree.depth[k]):
            continue
        total, parent, scale, cands = tree.stats[k], float(impurity(tree.stats[k], rules.criterion)), _scale(tree.stats[k], rules.criterion), []
        for f in drawn(key, tree.place[k], d) if most < d else range(d):
            order = own[np.argsort(x[own, f], kind="stable")]
            v = x[order, f]
            at = np.flatnonzero(v[1:] != v[:-1])
            if not len(at):
                continue  # a constant feature has no cut and doesn't count as drawn
            left, n = np.cumsum(s[order], 0)[at], np.cumsum(times[order])[at]
            right = total - left
            gain = parent - (_weight(left, rules.criterion) * impurity(left, rules.criterion) + _weight(right, rules.criterion) * impurity(right, rules.criterion)) / _weight(total, rules.criterion)
            gain[(n < rules.min_samples_leaf) | (tree.rows[k] - n < rules.min_samples_leaf)] = -scale
            b = int(np.round(gain / scale, DIGITS).argmax())
            cands.append({"f": f, "gain": float(gain[b]), "cut": (v[at[b]] + v[at[b] + 1]) / 2, "left": left[b], "n_left": n[b]})
            if len(cands) == most:
                break
        c = best_of(sorted(cands, key=lambda c: c["f"]), scale)
        if c is None or float(_weight(total, rules.criterion)) / whole * c["gain"] < rules.min_impurity_decrease:
            continue
        low = x[own, c["f"]] <= c["cut"]
        a, b = tree.split(k, c)
        stack += [(b, own[~low]), (a, own[low])]
    return tree.freeze()


class _Places:
    """Sends rows down growing trees: of each row with a weight in a tree, the open node that it stands in."""

    def __init__(self, trees: list[Tree], opened: list[tuple[int, int]], m: int, shared: bool, counted: bool):
        self.arrays = [t.arrays() for t in trees]
        self.slots = [np.full(len(t.feature), -1) for t in trees]
        for slot, (t, k) in enumerate(opened):
            self.slots[t][k] = slot
        self.m, self.shared, self.counted = m, shared, counted

    def rows(self, batch):
        """For each tree: its number, the features, statistics, count and open node of the rows that stand in one."""
        x, s = matrix(batch.column("x")), matrix(batch.column("s"))
        w = matrix(batch.column("w")) if "w" in batch.schema.names else None
        for t, (arrays, slots) in enumerate(zip(self.arrays, self.slots, strict=True)):
            if (slots < 0).all():
                continue
            slot = slots[descend(arrays, x)]
            own = np.flatnonzero((slot >= 0) & (w[:, t] > 0) if w is not None else slot >= 0)
            if not len(own):
                continue
            stats = s[own] if self.shared else s[own, t * self.m : (t + 1) * self.m]
            weight = np.ones(len(own)) if w is None else w[own, t]
            yield t, x[own], stats * weight[:, None], weight if self.counted else np.ones(len(own)), slot[own]


def _columns(m: int) -> list[str]:
    return ["n", *(f"s{k}" for k in range(m))]


def _added_up(slot, x, s, n, tried: np.ndarray):
    """For each feature: nodes, distinct values and summed n and s of rows, as columns."""
    for f in range(x.shape[1]):
        own = np.flatnonzero(tried[slot, f])
        if not len(own):
            continue
        v, node = x[own, f] + 0.0, slot[own]
        order = np.lexsort((v, node))
        v, node, own = v[order], node[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (node[1:] != node[:-1])]))
        yield node[first].astype(np.int32), np.full(len(first), f, np.int32), v[first], *(np.add.reduceat(c[own], first) for c in (n, *s.T))


def _values(base: DataFrame, places, tried: np.ndarray) -> DataFrame:
    """(node, f, v) with summed statistics, for each open node's distinct values of the features tried there.

    Each task adds up equal values of a bounded number of rows before it sends any: a row of its own for every value of
    every feature of every row costs most of a level.
    """
    names = _columns(places.value.m)

    def run(batches):
        waiting, cells = [], 0

        def sent():
            for columns in _added_up(*(np.concatenate(c) for c in zip(*waiting, strict=True)), tried) if waiting else ():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "f", "v", *names])

        for batch in batches:
            for _, x, s, n, slot in places.value.rows(batch) if batch.num_rows else ():
                waiting.append((slot, x, s, n))
                cells += x.size + s.size
            if cells >= WAITING:
                yield from sent()
                waiting, cells = [], 0
        yield from sent()

    spread = base.mapInArrow(run, "node int, f int, v double, " + ", ".join(f"{c} double" for c in names))
    return spread.groupBy("node", "f", "v").agg(*[F.sum(c).alias(c) for c in names])


def prefix_scan(values: DataFrame, names: list[str]) -> DataFrame:
    """(range, node, f, v, last, before, ending) of values(node, f, v, *names), range by range in order.

    last is the value before v in its range (null at the first), before the sums of all smaller ones in the range. A row
    with ending set closes each node and feature in each range and holds its greatest value and its totals.
    """
    ordered = values.repartitionByRange("node", "f", "v").sortWithinPartitions("node", "f", "v")

    def run(batches):
        part, now, sums, last = TaskContext.get().partitionId(), None, None, None
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.bool_()]
        fields = ["range", "node", "f", "v", "last", "before", "ending"]

        def closing():
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip([part, *now, None, last, sums.tolist(), True], kinds, strict=True)], names=fields)

        for batch in batches:
            node, f, v = (np.asarray(batch.column(c)) for c in ("node", "f", "v"))
            own = np.column_stack([np.asarray(batch.column(c), float) for c in names])
            edges = [0, *(1 + np.flatnonzero((node[1:] != node[:-1]) | (f[1:] != f[:-1]))), len(v)] if len(v) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if now != (node[a], f[a]):
                    if now is not None:
                        yield closing()
                    now, sums, last = (node[a], f[a]), np.zeros(own.shape[1]), None
                run_sums = sums + np.cumsum(own[a:b], 0)
                before = np.vstack([sums, run_sums[:-1]])
                lasts = pa.array([last, *v[a : b - 1].tolist()], pa.float64())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, before.size + 1, before.shape[1]), pa.int32()), pa.array(before.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, np.int32)), pa.array(node[a:b]), pa.array(f[a:b]), pa.array(v[a:b]), lasts, flat, pa.array(np.zeros(b - a, bool))], names=fields)
                sums, last = run_sums[-1], float(v[b - 1])
        if now is not None:
            yield closing()

    return ordered.mapInArrow(run, "range int, node int, f int, v double, last double, before array<double>, ending boolean")


def best_cuts(scanned: DataFrame, m: int, rules: Rules) -> DataFrame:
    """(node, f, gain, cut, left, n_left): the best cut of each node, from the rows of a prefix scan."""
    names = _columns(m)
    totals = scanned.where("ending").select("range", "node", "f", F.col("last").alias("high"), *[F.get("before", F.lit(k)).alias(c) for k, c in enumerate(names)])
    order = Window.partitionBy("node", "f").orderBy("range")
    so_far, all_of = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("node", "f")
    totals = totals.select("range", "node", "f", F.lag("high").over(order).alias("high"), *[F.coalesce(F.sum(c).over(so_far), F.lit(0.0)).alias(f"e_{c}") for c in names], *[F.sum(c).over(all_of).alias(f"t_{c}") for c in names])
    rows = scanned.where("not ending").join(totals, ["range", "node", "f"]).withColumn("last", F.coalesce("last", "high")).where("last is not null")
    lefts = [F.get("before", F.lit(k)) + F.col(f"e_{c}") for k, c in enumerate(names)]
    rows = rows.select("node", "f", ((F.col("v") + F.col("last")) / 2).alias("cut"), *[c.alias(f"l_{n}") for c, n in zip(lefts, names, strict=True)], *[f"t_{c}" for c in names])
    left, total = ([F.col(f"{side}_s{k}") for k in range(m)] for side in "lt")
    right = [t - a for a, t in zip(left, total, strict=True)]
    weight = (lambda s: s[0]) if rules.criterion == "squared_error" else (lambda s: sum(s[1:], s[0]))
    parent = _impurity_column(total, rules.criterion)
    scale = parent if rules.criterion == "squared_error" else F.lit(1.0)
    gain = parent - (weight(left) * _impurity_column(left, rules.criterion) + weight(right) * _impurity_column(right, rules.criterion)) / weight(total)
    fits = (F.col("l_n") >= rules.min_samples_leaf) & (F.col("t_n") - F.col("l_n") >= rules.min_samples_leaf)
    cuts = rows.select("node", "f", scale.alias("scale"), F.when(fits, gain).otherwise(-scale).alias("gain"), "cut", F.array(*left).alias("left"), F.col("l_n").alias("n_left"))
    found = F.struct("f", "gain", "cut", "left", "n_left", "scale")
    by_feature = cuts.groupBy("node", "f").agg(F.max_by(found, F.struct(F.round(F.col("gain") / F.col("scale"), DIGITS).alias("g"), (-F.col("cut")).alias("c"))).alias("b"))
    nodes = by_feature.groupBy("node").agg(F.sort_array(F.collect_list("b")).alias("bs"))  # one entry a feature
    slack = lambda c: c["scale"] * TOLERANCE
    better = lambda a, c: (c["gain"] > slack(c)) & (a["f"].isNull() | (c["gain"] > a["gain"] + slack(c)))
    none = F.lit(None).cast(by_feature.schema["b"].dataType)
    best = F.aggregate("bs", none, lambda a, c: F.when(better(a, c), c).otherwise(a))
    return nodes.select("node", best.alias("b")).where("b is not null").select("node", "b.f", "b.gain", "b.cut", "b.left", "b.n_left")


def _tried(base: DataFrame, places, keys: list[str], d: int, most: int) -> np.ndarray:
    """By open node and feature, whether it is among the first `most` drawn that are not constant there."""
    tried = np.ones((len(keys), d), bool)
    if most == d:
        return tried

    def run(batches):
        for batch in batches:
            for _, x, _, _, slot in places.value.rows(batch) if batch.num_rows else ():
                order = np.argsort(slot, kind="stable")
                nodes, starts = np.unique(slot[order], return_index=True)
                low, high = np.minimum.reduceat(x[order], starts, 0), np.maximum.reduceat(x[order], starts, 0)
                columns = [np.repeat(nodes, d).astype(np.int32), np.tile(np.arange(d, dtype=np.int32), len(nodes)), low.ravel(), high.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "f", "low", "high"])

    spread = base.mapInArrow(run, "node int, f int, low double, high double").groupBy("node", "f").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    named = base.sparkSession.createDataFrame(list(enumerate(keys)), "node int, key string")
    hashed = F.md5(F.concat_ws(":", "key", F.col("f").cast("string")))
    first = spread.join(named, "node").groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct(hashed.alias("h"), "f"))), 1, most).alias("fs"))  # one entry a feature
    tried[:] = False
    for r in first.select("node", F.transform("fs", lambda x: x["f"]).alias("fs")).collect():
        tried[r["node"], r["fs"]] = True
    return tried


def _finish(base: DataFrame, places, whole: list, rules: Rules, d: int, m: int) -> dict[int, Tree]:
    """The parts of trees below open nodes that each fit one task. whole: by node, what grow_local needs to know."""

    def send(batches):
        for batch in batches:
            for _, x, s, n, slot in places.value.rows(batch) if batch.num_rows else ():
                arrays = [pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, c.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(c).ravel())) for c in (x, s)]
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), *arrays, pa.array(n)], names=["node", "x", "s", "n"])

    def one(table):
        slot = table.column("node")[0].as_py()
        x, s, n = matrix(table.column("x")), matrix(table.column("s")), np.asarray(table.column("n"))
        order = np.lexsort([*s.T, n, *x.T])  # sums must not depend on the order of arrival
        tree = grow_local(x[order], s[order], rules, times=n[order], **whole[slot])
        return pa.table({"node": pa.array([slot], pa.int32()), "tree": pa.array([pickle.dumps(tree)])})

    sent = base.mapInArrow(send, "node int, x array<double>, s array<double>, n double")
    return {r["node"]: pickle.loads(bytes(r["tree"])) for r in sent.groupBy("node").applyInArrow(one, "node int, tree binary").toLocalIterator()}


def grow_all(base: DataFrame, m: int, d: int, rules: Rules, keys: list[str], shared: bool = True, counted: bool = False, local_cells: int = LOCAL_CELLS) -> list[Tree]:
    """A tree for each key, over base(x, s[, w]): features, statistics and weights.

    s holds m numbers, the same for all trees (shared), or m for each tree in turn. w holds a weight for each tree, by which
    a row's statistics are multiplied; a row without weight is not in that tree, and all have weight 1 without the column.
    counted: a row of weight 3 counts as three rows. base is read once a level and should be cheap to read.
    """
    rules.check()
    spark, most = base.sparkSession, resolve_max_features(rules.max_features, d)
    trees = [Tree(rules.criterion) for _ in keys]
    totals = _totals(base, m, len(keys), shared, counted)
    for t, tree in enumerate(trees):
        tree.add(totals[t][1:], totals[t][0])
    whole = [float(_weight(t.stats[0], rules.criterion)) if t.rows[0] else 1.0 for t in trees]
    may = lambda t, k: rules.may_split(trees[t].stats[k], trees[t].rows[k], trees[t].depth[k])
    frontier, small = [(t, 0) for t in range(len(keys)) if trees[t].rows[0] and may(t, 0)], []
    while frontier:
        small += [(t, k) for t, k in frontier if trees[t].rows[k] * d <= local_cells]
        frontier = [(t, k) for t, k in frontier if trees[t].rows[k] * d > local_cells]
        if not frontier:
            break
        places = spark.sparkContext.broadcast(_Places(trees, frontier, m, shared, counted))
        tried = _tried(base, places, [f"{keys[t]}:{trees[t].place[k]}" for t, k in frontier], d, most)
        with Held(prefix_scan(_values(base, places, tried), _columns(m)), "tree-values") as scanned:
            found = best_cuts(scanned, m, rules).collect()
        places.destroy()
        after = []
        for r in sorted(found, key=lambda r: r["node"]):
            t, k = frontier[r["node"]]
            if float(_weight(trees[t].stats[k], rules.criterion)) / whole[t] * r["gain"] >= rules.min_impurity_decrease:
                after += [(t, j) for j in trees[t].split(k, r.asDict()) if may(t, j)]
        frontier = after
    if small:
        places = spark.sparkContext.broadcast(_Places(trees, small, m, shared, counted))
        known = [{"key": keys[t], "whole": whole[t], "depth": trees[t].depth[k], "place": trees[t].place[k]} for t, k in small]
        for slot, below in sorted(_finish(base, places, known, rules, d, m).items()):
            t, k = small[slot]
            trees[t].graft(k, below)
        places.destroy()
    return [t.freeze() for t in trees]


def grow(df: DataFrame, m: int, d: int, rules: Rules, key: str = "0", local_cells: int = LOCAL_CELLS) -> Tree:
    """One tree over df(x, s): features and statistics."""
    return grow_all(df, m, d, rules, [key], local_cells=local_cells)[0]


def _totals(base: DataFrame, m: int, count: int, shared: bool, counted: bool) -> np.ndarray:
    """By tree, its rows and the sums of its statistics."""
    roots = [Tree("gini") for _ in range(count)]
    for r in roots:
        r.add(np.zeros(m), 0)
    places, names = _Places(roots, [(t, 0) for t in range(count)], m, shared, counted), _columns(m)

    def run(batches):
        sums = np.zeros((count, m + 1))
        for batch in batches:
            for t, _, s, n, _ in places.rows(batch) if batch.num_rows else ():
                sums[t] += [n.sum(), *s.sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), *[pa.array(c) for c in sums.T]], names=["t", *names])

    out = np.zeros((count, m + 1))
    for r in base.mapInArrow(run, "t int, " + ", ".join(f"{c} double" for c in names)).groupBy("t").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["t"]] = [r[c] for c in names]
    return out


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a 2-D array as an array<double> column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x, float).ravel()))


def apply_kernel(df: DataFrame, features: str, into: str, kernel, kind=None, width: int | None = None) -> DataFrame:
    """df with `into` = kernel(x), an Arrow-batched function of the feature matrix (the model travels with it).

    With width, a row of another number of features is an error.
    """
    kind = kind or T.ArrayType(T.DoubleType())
    held = [c for c in df.columns if c != into]
    schema = T.StructType([*(df.schema[c] for c in held), T.StructField(into, kind)])

    def run(batches):
        for batch in batches:
            if width is not None and batch.num_rows:
                sizes = pc.unique(pc.list_value_length(batch.column(features))).to_pylist()
                if sizes != [width]:
                    raise ValueError(f"expected {width} features, got {sorted({width, *sizes} - {width}, key=str)}")
            got = kernel(matrix(batch.column(features))) if batch.num_rows else np.zeros((0, 1))
            arrow = lists(got) if isinstance(kind, T.ArrayType) else pa.array(got)
            yield pa.RecordBatch.from_arrays([*batch.select(held).columns, arrow], names=[*held, into])

    return df.select(*held).mapInArrow(run, schema)


def class_stats(target: Column, classes: np.ndarray, weight: Column) -> Column:
    return F.array(*[F.when(target == F.lit(c.item()), weight).otherwise(0.0) for c in classes])


def moment_stats(y: Column, weight: Column) -> Column:
    return F.array(weight, weight * y, weight * y * y)


class _TreeModel(Estimator):
    def _rules(self) -> Rules:
        return Rules(self.criterion, self.max_depth, self.min_samples_split, self.min_samples_leaf, self.min_impurity_decrease, self.max_features)

    def _grow(self, df, features, stats, m, d, weight_col, local_cells):
        seed = int(check_random_state(self.random_state).integers(2**31))
        rows = df.where(weight_col > 0).select(F.col(features).alias("x"), stats.alias("s"))
        self.tree_ = grow_all(rows, m, d, self._rules(), [f"{seed}:0"], local_cells=local_cells)[0]
        self.n_features_, self.feature_importances_ = d, self.tree_.importances(d)
        return self

    def to_df(self, spark) -> DataFrame:
        check_is_fitted(self, "tree_")
        return spark.createDataFrame(self.tree_.to_rows(), "node_id int, feature int, threshold double, left_id int, right_id int, value array<double>, impurity double, n_samples long")


class DecisionTreeClassifier(_TreeModel):
    def __init__(self, criterion: str = "gini", max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1, min_impurity_decrease: float = 0.0, max_features=None, random_state=None):
        self.criterion, self.max_depth, self.min_samples_split, self.min_samples_leaf, self.min_impurity_decrease, self.max_features, self.random_state = criterion, max_depth, min_samples_split, min_samples_leaf, min_impurity_decrease, max_features, random_state

    def fit(self, df: DataFrame, features: str = "features", target: str = "y", weight: str | None = None, local_cells: int = LOCAL_CELLS, most_classes: int = 10_000) -> DecisionTreeClassifier:
        if self.criterion not in ("gini", "entropy"):
            raise ValueError(f"unknown criterion {self.criterion!r}")
        _, d = check_frame(df, features, target, weight)
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        self.classes_ = classes_of(df, target, most_classes)
        return self._grow(df, features, class_stats(F.col(target), self.classes_, w), len(self.classes_), d, w, local_cells)

    def predict_proba(self, df: DataFrame, features: str = "features", into: str = "proba") -> DataFrame:
        check_is_fitted(self, "tree_")
        tree = self.tree_
        return apply_kernel(df, features, into, lambda x: tree.value[tree.leaves(x)], width=self.n_features_)

    def predict(self, df: DataFrame, features: str = "features", into: str = "prediction") -> DataFrame:
        check_is_fitted(self, "tree_")
        tree, classes = self.tree_, self.classes_
        kind = T.DoubleType() if classes.dtype.kind == "f" else T.LongType()
        return apply_kernel(df, features, into, lambda x: classes[tree.value[tree.leaves(x)].argmax(1)], kind, self.n_features_)

    def score(self, df: DataFrame, features: str = "features", target: str = "y") -> float:
        return self.predict(df, features, "__p").agg(F.avg((F.col("__p") == F.col(target)).cast("double")).alias("v")).first()["v"]


class DecisionTreeRegressor(_TreeModel):
    def __init__(self, criterion: str = "squared_error", max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1, min_impurity_decrease: float = 0.0, max_features=None, random_state=None):
        self.criterion, self.max_depth, self.min_samples_split, self.min_samples_leaf, self.min_impurity_decrease, self.max_features, self.random_state = criterion, max_depth, min_samples_split, min_samples_leaf, min_impurity_decrease, max_features, random_state

    def fit(self, df: DataFrame, features: str = "features", target: str = "y", weight: str | None = None, local_cells: int = LOCAL_CELLS) -> DecisionTreeRegressor:
        if self.criterion != "squared_error":
            raise ValueError(f"unknown criterion {self.criterion!r}")
        _, d = check_frame(df, features, target, weight)
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        self.center_ = df.agg(F.avg(F.col(target).cast("double")).alias("m")).first()["m"]
        return self._grow(df, features, moment_stats(F.col(target).cast("double") - self.center_, w), 3, d, w, local_cells)

    def predict(self, df: DataFrame, features: str = "features", into: str = "prediction") -> DataFrame:
        check_is_fitted(self, "tree_")
        tree, center = self.tree_, self.center_
        return apply_kernel(df, features, into, lambda x: tree.value[tree.leaves(x), 0] + center, T.DoubleType(), self.n_features_)

    def score(self, df: DataFrame, features: str = "features", target: str = "y") -> float:
        from quillon.operators import metrics

        return metrics.r2_score(self.predict(df, features, "__p"), target, "__p")
