"""Forests, SAMME boosting and gradient boosting over the exact trees.

A forest is one frontier: all its trees grow in the same jobs. Boosting keeps a table of the rows' state (weights or scores),
written once a round, in which each round evaluates its own trees only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import expr
from quillon.functions.base import Estimator, check_frame, check_is_fitted, check_random_state, classes_of
from quillon.functions.held import Held
from quillon.functions.stats import matrix
from quillon.operators.tree import LOCAL_CELLS, Rules, apply_kernel, class_stats, grow_all, lists, moment_stats


def _softmax(z):
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _smallest(numbers: DataFrame, k: int) -> int:
    """The k-th smallest of numbers(u) below 2 ** 40: counts by the upper 16 bits, then only one slice is ordered."""
    upper = F.shiftright("u", 24)
    before = 0
    for r in sorted(numbers.groupBy(upper.alias("s")).count().collect(), key=lambda r: r["s"]):
        if before + r["count"] >= k:
            return numbers.where(upper == r["s"]).orderBy("u").limit(k - before).agg(F.max("u").alias("m")).first()["m"]
        before += r["count"]
    raise ValueError("fewer numbers than asked for")


#: The chances that a Poisson(1) number is at most 0, 1, ...
POISSON = np.cumsum([np.exp(-1) / np.prod(range(1, j + 1)) for j in range(12)])


def bag_counts(name: Column, seed: int, trees: int) -> Column:
    """How often a row is in the bag of each tree, as array<double>: Poisson(1) by the MD5 of `name:seed:tree`."""
    limits = F.array(*[F.lit(float(c)) for c in POISSON])
    digits = lambda t: F.substring(F.md5(F.concat_ws(":", name, F.lit(str(seed)), t.cast("string"))), 1, 12)
    share = lambda t: F.conv(digits(t), 16, 10).cast("double") / float(1 << 48)
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.aggregate(F.transform(F.array(share(t)), lambda u: F.size(F.filter(limits, lambda c: u >= c)).cast("double")), F.lit(0.0), lambda a, b: a + b))


class _Classifier(Estimator):
    def _labelled(self, df, features, into, proba):
        classes = self.classes_
        kind = T.DoubleType() if classes.dtype.kind == "f" else T.LongType()
        return apply_kernel(df, features, into, lambda x: classes[proba(x).argmax(1)], kind, self.n_features_)

    def score(self, df: DataFrame, features: str = "features", target: str = "y") -> float:
        return self.predict(df, features, "__p").agg(F.avg((F.col("__p") == F.col(target)).cast("double")).alias("v")).first()["v"]


class RandomForestClassifier(_Classifier):
    """Mean class shares of trees on bootstrap samples: each row counts Poisson(1) times, by a hash of its key and the tree.

    Counts and the features drawn at a node are hashes of (row, tree) and (tree, place, feature), so neither the order of
    work nor the size of the table matters, and all trees grow in one aggregate a level. Equal rows count by themselves
    where there is a key column; without one they share their counts.
    """

    def __init__(self, n_estimators: int = 100, criterion: str = "gini", max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1, min_impurity_decrease: float = 0.0, max_features="sqrt", bootstrap: bool = True, oob_score: bool = False, random_state=None):
        self.n_estimators, self.criterion, self.max_depth, self.min_samples_split, self.min_samples_leaf, self.min_impurity_decrease, self.max_features, self.bootstrap, self.oob_score, self.random_state = n_estimators, criterion, max_depth, min_samples_split, min_samples_leaf, min_impurity_decrease, max_features, bootstrap, oob_score, random_state

    def fit(self, df: DataFrame, features: str = "features", target: str = "y", local_cells: int = LOCAL_CELLS, key: str = "row_id", most_classes: int = 10_000) -> RandomForestClassifier:
        """local_cells: a node of up to so many numbers is finished by one task; the trees are the same for any."""
        if self.n_estimators < 1 or self.oob_score and not self.bootstrap:
            raise ValueError("n_estimators must be positive; oob_score needs bootstrap")
        _, d = check_frame(df, features, target)
        self.classes_, self.n_features_ = classes_of(df, target, most_classes), d
        rules = Rules(self.criterion, self.max_depth, self.min_samples_split, self.min_samples_leaf, self.min_impurity_decrease, self.max_features)
        self.seed_ = int(check_random_state(self.random_state).integers(2**31))
        name = F.col(key).cast("string") if key in df.columns else F.xxhash64(features, target).cast("string")
        rows = df.select(F.col(features).alias("x"), class_stats(F.col(target), self.classes_, F.lit(1.0)).alias("s"), *([bag_counts(name, self.seed_, self.n_estimators).alias("w")] if self.bootstrap else []))
        with Held(rows, "forest") as base:
            self.trees_ = grow_all(base, len(self.classes_), d, rules, [f"{self.seed_}:{t}" for t in range(self.n_estimators)], counted=True, local_cells=local_cells)
            if self.oob_score:
                self.oob_score_ = self._oob(base)
        total = np.mean([t.importances(d) for t in self.trees_], 0)
        self.feature_importances_ = total / total.sum() if total.sum() else total
        return self

    def _oob(self, base: DataFrame) -> float:
        """Accuracy over the rows that some tree has not seen, each by the mean shares of those trees."""
        trees = self.trees_

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, s, out = matrix(batch.column("x")), matrix(batch.column("s")), matrix(batch.column("w")) == 0
                total = np.zeros(s.shape)
                for t, tree in enumerate(trees):
                    total[out[:, t]] += tree.value[tree.leaves(x[out[:, t]])]
                seen = out.any(1)
                yield pa.RecordBatch.from_arrays([pa.array([int(seen.sum())]), pa.array([int((total[seen].argmax(1) == s[seen].argmax(1)).sum())])], names=["seen", "right"])

        r = base.mapInArrow(run, "seen long, right long").agg(F.sum("right").alias("right"), F.sum("seen").alias("seen")).first()
        return r["right"] / r["seen"] if r["seen"] else float("nan")

    def _proba(self):
        check_is_fitted(self, "trees_")
        trees = self.trees_
        return lambda x: np.mean([t.value[t.leaves(x)] for t in trees], 0)

    def predict_proba(self, df: DataFrame, features: str = "features", into: str = "proba") -> DataFrame:
        return apply_kernel(df, features, into, self._proba(), width=self.n_features_)

    def predict(self, df: DataFrame, features: str = "features", into: str = "prediction") -> DataFrame:
        return self._labelled(df, features, into, self._proba())


class AdaBoostClassifier(_Classifier):
    """SAMME. A table of the rows and their weights goes from round to round: each writes it once, with what its tree says."""

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, max_depth: int = 1):
        self.n_estimators, self.learning_rate, self.max_depth = n_estimators, learning_rate, max_depth

    def fit(self, df: DataFrame, features: str = "features", target: str = "y", weight: str | None = None, local_cells: int = LOCAL_CELLS, most_classes: int = 10_000) -> AdaBoostClassifier:
        if self.n_estimators < 1 or self.learning_rate <= 0:
            raise ValueError("n_estimators and learning_rate must be positive")
        _, d = check_frame(df, features, target, weight)
        self.classes_, self.n_features_ = classes_of(df, target, most_classes), d
        k = len(self.classes_)
        if k < 2:
            raise ValueError("two classes are needed")
        start = F.col(weight).cast("double") if weight else F.lit(1.0)
        number = F.array_position(F.array(*[F.lit(c.item()) for c in self.classes_]), F.col(target)).cast("double") - 1
        state = df.select(F.col(features).alias("x"), number.alias("c"), start.alias("w")).where("w > 0")
        rules, held = Rules("gini", self.max_depth), None
        self.trees_, self.estimator_weights_, self.estimator_errors_ = [], [], []
        for round_ in range(self.n_estimators):
            stats = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(F.col("c") == j, F.col("w")).otherwise(0.0))
            tree = grow_all(state.select("x", stats.alias("s")), k, d, rules, [f"boost:{round_}"], local_cells=local_cells)[0]
            says = apply_kernel(state, "x", "p", lambda x, t=tree: t.value[t.leaves(x)].argmax(1).astype(float), T.DoubleType(), d)
            last, held = held, Held(says, "boost")
            if last:
                last.drop()
            r = held.df.agg(F.sum(F.when(F.col("p") != F.col("c"), F.col("w")).otherwise(0.0)).alias("bad"), F.sum("w").alias("all")).first()
            err = r["bad"] / r["all"]
            if err <= 0:
                self.trees_.append(tree)
                self.estimator_weights_.append(1.0)
                self.estimator_errors_.append(0.0)
                break
            if err >= 1 - 1 / k:
                if not self.trees_:
                    held.drop()
                    raise ValueError("the first learner is no better than chance")
                break
            alpha = self.learning_rate * (np.log((1 - err) / err) + np.log(k - 1))
            self.trees_.append(tree)
            self.estimator_weights_.append(float(alpha))
            self.estimator_errors_.append(err)
            # weights add up to one again, so they neither grow nor vanish over many rounds
            missed = F.when(F.col("p") != F.col("c"), float(np.exp(alpha))).otherwise(1.0)
            state = held.df.select("x", "c", (F.col("w") * missed / (r["all"] + r["bad"] * (float(np.exp(alpha)) - 1))).alias("w"))
        held.drop()
        w = np.array(self.estimator_weights_)
        total = sum(a * t.importances(d) for a, t in zip(w, self.trees_))
        self.feature_importances_ = total / total.sum() if total.sum() else total
        return self

    def _votes(self, rounds=None):
        check_is_fitted(self, "trees_")
        trees, alphas, k = self.trees_[:rounds], np.array(self.estimator_weights_[:rounds]), len(self.classes_)

        def votes(x):
            out = np.zeros((len(x), k))
            for t, a in zip(trees, alphas):
                hot = np.eye(k)[t.value[t.leaves(x)].argmax(1)]
                out += a * np.where(hot > 0, 1.0, -1 / (k - 1))
            return out / alphas.sum()

        return votes

    def decision_function(self, df: DataFrame, features: str = "features", into: str = "decision") -> DataFrame:
        """An array by class; for two classes one number, the second's lead."""
        votes = self._votes()
        if len(self.classes_) == 2:
            return apply_kernel(df, features, into, lambda x: (v := votes(x))[:, 1] - v[:, 0], T.DoubleType(), self.n_features_)
        return apply_kernel(df, features, into, votes, width=self.n_features_)

    def predict_proba(self, df: DataFrame, features: str = "features", into: str = "proba") -> DataFrame:
        votes, k = self._votes(), len(self.classes_)
        return apply_kernel(df, features, into, lambda x: _softmax(votes(x) / (k - 1)), width=self.n_features_)

    def predict(self, df: DataFrame, features: str = "features", into: str = "prediction") -> DataFrame:
        return self._labelled(df, features, into, self._votes())

    def staged_predict(self, df: DataFrame, features: str = "features", into: str = "prediction") -> Iterator[DataFrame]:
        for n in range(1, len(self.trees_) + 1):
            yield self._labelled(df, features, into, self._votes(n))

    def staged_score(self, df: DataFrame, features: str = "features", target: str = "y") -> Iterator[float]:
        for said in self.staged_predict(df, features, "__p"):
            yield said.agg(F.avg((F.col("__p") == F.col(target)).cast("double")).alias("v")).first()["v"]


def _rest(k: int) -> Column:
    """What the class chances of raw scores leave of `hot`: of the second of two classes, or of each of more."""
    if k == 2:
        return F.array(F.get("hot", F.lit(0)) - expr.sigmoid(F.get("raw", F.lit(0))))
    return F.zip_with("hot", expr.softmax(F.col("raw")), lambda y, q: y - q)


def _leaf_sums(rows: DataFrame, trees: list) -> dict[tuple[int, int], tuple[float, float]]:
    """By tree and leaf, the sums of w r and w |r| (1 - |r|) over rows(x, rest, w), r the tree's own part of rest."""

    def run(batches):
        sums = [np.zeros((2, len(t.feature))) for t in trees]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rest, w = matrix(batch.column("x")), matrix(batch.column("rest")), np.asarray(batch.column("w"))
            for c, t in enumerate(trees):
                leaf, r = t.leaves(x), rest[:, c]
                for own, add in zip(sums[c], (w * r, w * np.abs(r) * (1 - np.abs(r))), strict=True):
                    own += np.bincount(leaf, add, len(own))
        for c, own in enumerate(sums):
            at = np.flatnonzero(own.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), *(pa.array(o[at]) for o in own)], names=["c", "leaf", "a", "b"])

    parts = rows.select("x", "rest", "w").mapInArrow(run, "c int, leaf int, a double, b double")
    return {(g["c"], g["leaf"]): (g["a"], g["b"]) for g in parts.groupBy("c", "leaf").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}  # one row a leaf


def _moved(rows: DataFrame, trees: list, rate: float) -> DataFrame:
    """rows with `raw` moved by rate times what each tree says of x."""
    held = [c for c in rows.columns if c != "raw"]

    def run(batches):
        for batch in batches:
            x, raw = matrix(batch.column("x")), matrix(batch.column("raw"))
            new = raw + rate * np.stack([t.value[t.leaves(x), 0] for t in trees], 1) if batch.num_rows else np.zeros((0, len(trees)))
            yield pa.RecordBatch.from_arrays([*batch.select(held).columns, lists(new)], names=[*held, "raw"])

    schema = T.StructType([*(rows.schema[c] for c in held), rows.schema["raw"]])
    return rows.select(*held, "raw").mapInArrow(run, schema)


class GradientBoostingClassifier(_Classifier):
    """Log-loss boosting of regression trees with Newton leaves; several classes get a tree each a round."""

    def __init__(self, learning_rate: float = 0.1, n_estimators: int = 100, subsample: float = 1.0, max_depth: int = 3, min_samples_split: int = 2, min_samples_leaf: int = 1, min_impurity_decrease: float = 0.0, max_features=None, init: str = "prior", random_state=None):
        self.learning_rate, self.n_estimators, self.subsample, self.max_depth, self.min_samples_split, self.min_samples_leaf, self.min_impurity_decrease, self.max_features, self.init, self.random_state = learning_rate, n_estimators, subsample, max_depth, min_samples_split, min_samples_leaf, min_impurity_decrease, max_features, init, random_state

    def fit(self, df: DataFrame, features: str = "features", target: str = "y", weight: str | None = None, key: str = "row_id", local_cells: int = LOCAL_CELLS, most_classes: int = 10_000) -> GradientBoostingClassifier:
        """Rows and their raw scores go from round to round in a table: each round writes it once, moved by its own trees."""
        if self.learning_rate <= 0 or self.n_estimators < 1 or not 0 < self.subsample <= 1 or self.init not in ("prior", "zero"):
            raise ValueError("bad boosting parameters")
        n, d = check_frame(df, features, target, weight)
        self.classes_, self.n_features_ = classes_of(df, target, most_classes), d
        k = len(self.classes_)
        if k < 2:
            raise ValueError("two classes are needed")
        outputs = 1 if k == 2 else k
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        hot = F.array(*[(F.col(target) == F.lit(c.item())).cast("double") for c in (self.classes_[1:] if k == 2 else self.classes_)])
        name = F.xxhash64(*([key] if key in df.columns else [features, target]))
        base = df.select(F.col(features).alias("x"), hot.alias("hot"), w.alias("w"), *([name.alias("name")] if self.subsample < 1 else []))
        shares = base.agg(*[(F.sum(F.col("w") * F.get("hot", F.lit(c))) / F.sum("w")).alias(f"p{c}") for c in range(outputs)]).first()
        p = np.clip([shares[f"p{c}"] for c in range(outputs)], 1e-12, 1 - 1e-12)
        self.init_ = np.zeros(outputs) if self.init == "zero" else np.log(p / (1 - p)) if k == 2 else np.log(p)
        rules = Rules("squared_error", self.max_depth, self.min_samples_split, self.min_samples_leaf, self.min_impurity_decrease, self.max_features)
        rng = check_random_state(self.random_state)
        factor, rate = 1.0 if k == 2 else (k - 1) / k, self.learning_rate
        self.trees_, self.train_score_, held = [], [], None
        state = base.withColumn("raw", F.array(*[F.lit(float(v)) for v in self.init_]))
        for round_ in range(self.n_estimators):
            bag = F.lit(True)
            if self.subsample < 1:
                u = F.pmod(F.xxhash64("name", F.lit(int(rng.integers(2**31)))), F.lit(1 << 40))
                bag = u <= _smallest(state.select(u.alias("u")), round(self.subsample * n))
            rows = state.where(bag & (F.col("w") > 0)).withColumn("rest", _rest(k))
            moments = moment_stats(F.get("rest", F.lit(0)), F.col("w")) if outputs == 1 else F.flatten(F.transform("rest", lambda r: moment_stats(r, F.col("w"))))
            keys = [f"{int(rng.integers(2**31))}:{c}" for c in range(outputs)]
            grown = grow_all(rows.select("x", moments.alias("s")), 3, d, rules, keys, shared=False, local_cells=local_cells)
            for tree in grown:
                tree.value = np.zeros((len(tree.feature), 1))
            for (c, leaf), (up, steep) in _leaf_sums(rows, grown).items():
                grown[c].value[leaf, 0] = factor * up / steep if steep >= 1e-12 else 0.0
            last, held = held, Held(_moved(state, grown, rate), "boost")
            if last:
                last.drop()
            state = held.df
            self.trees_.append(grown)
            self.train_score_.append(self._deviance(state, k))
        held.drop()
        total = sum(t.importances(d) for ts in self.trees_ for t in ts)
        self.feature_importances_ = total / total.sum() if total.sum() else total
        return self

    def _raw(self, rounds=None):
        trees, start, rate = self.trees_[:rounds], self.init_, self.learning_rate
        return lambda x: start + rate * sum((np.stack([t.value[t.leaves(x), 0] for t in ts], 1) for ts in trees), np.zeros((len(x), len(start))))

    @staticmethod
    def _deviance(state: DataFrame, k: int) -> float:
        """Weighted mean log-loss."""
        if k == 2:
            z, y = F.get("raw", F.lit(0)), F.get("hot", F.lit(0))
            loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z
        else:
            loss = expr.logsumexp(F.col("raw")) - expr.dot(F.col("raw"), F.col("hot"))
        return state.agg((F.sum(F.col("w") * loss) / F.sum("w")).alias("v")).first()["v"]

    def _proba(self, rounds=None):
        check_is_fitted(self, "trees_")
        raw = self._raw(rounds)
        if len(self.classes_) == 2:
            return lambda x: np.column_stack([1 - (p := 1 / (1 + np.exp(-raw(x)))), p])
        return lambda x: _softmax(raw(x))

    def _decision(self, df, features, into, rounds=None):
        check_is_fitted(self, "trees_")
        raw = self._raw(rounds)
        if len(self.classes_) == 2:
            return apply_kernel(df, features, into, lambda x: raw(x)[:, 0], T.DoubleType(), self.n_features_)
        return apply_kernel(df, features, into, raw, width=self.n_features_)

    def decision_function(self, df: DataFrame, features: str = "features", into: str = "decision") -> DataFrame:
        return self._decision(df, features, into)

    def predict_proba(self, df: DataFrame, features: str = "features", into: str = "proba") -> DataFrame:
        return apply_kernel(df, features, into, self._proba(), width=self.n_features_)

    def predict(self, df: DataFrame, features: str = "features", into: str = "prediction") -> DataFrame:
        return self._labelled(df, features, into, self._proba())

    def staged_decision_function(self, df: DataFrame, features: str = "features", into: str = "decision") -> Iterator[DataFrame]:
        for n in range(1, len(self.trees_) + 1):
            yield self._decision(df, features, into, n)

    def staged(self, df: DataFrame, features: str = "features", into: str = "stages") -> DataFrame:
        """df with the raw scores after each round, one round after the other in one array: a single pass for all rounds."""
        check_is_fitted(self, "trees_")
        trees, start, rate = self.trees_, self.init_, self.learning_rate
        said = lambda x: np.stack([[t.value[t.leaves(x), 0] for t in ts] for ts in trees])  # noqa: E731  (round, output, row)
        return apply_kernel(df, features, into, lambda x: (start[:, None] + rate * np.cumsum(said(x), 0)).reshape(-1, len(x)).T, width=self.n_features_)

    def staged_predict_proba(self, df: DataFrame, features: str = "features", into: str = "proba") -> Iterator[DataFrame]:
        for n in range(1, len(self.trees_) + 1):
            yield apply_kernel(df, features, into, self._proba(n), width=self.n_features_)

    def staged_predict(self, df: DataFrame, features: str = "features", into: str = "prediction") -> Iterator[DataFrame]:
        for n in range(1, len(self.trees_) + 1):
            yield self._labelled(df, features, into, self._proba(n))
