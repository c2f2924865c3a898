"""Quality classifier: a sparse rule ensemble compiled to column expressions.

1. Statistics of the whole text (`statistics`) are plain column expressions.
2. A random forest is grown on a bounded sample of labelled rows; every path
   from a root to a node becomes a rule, a conjunction of bounds on statistics.
3. A logistic regression with a lasso penalty weighs the rules, by proximal Newton
   steps until its optimality conditions hold to ``TOLERANCE``; rules with weight
   zero are dropped. This step runs on the driver, on the sample's statistics: its
   size is that of the bounded sample.
4. The remaining rules are compiled back into one column expression, so scoring
   a corpus is a map over its rows without a join, a shuffle or Python.

The sample is the only bounded part: at most ``SAMPLE_ROWS`` labelled rows, the
ones with the smallest hash of their id, whatever the size of the corpus. All
rows are scored. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have zero statistics and get a score;
texts of any length are read whole, equal texts score alike;
rows with a null id are scored but not learned from; a document labelled twice
counts twice; rows with a null label are ignored; without labels the score is
0.5 everywhere, with one class only it is the smoothed share of that class;
an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import empty_if_null, forget, let, stored
from driftline.plans.materialize import broadcast_bounded

SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO = 12, 4, 0.002
TOLERANCE, MOST_ROUNDS = 1e-8, 200  # the lasso stops by its tolerance

#: classes of characters whose share of the text is a statistic
SHARES = {
    "upper": r"\p{Lu}", "digit": r"\p{Nd}", "mark": r"[^\p{L}\p{N}\s.,]", "bar": r"\|", "bang": r"[!?]",
    "sign": r"[#$%&*@~^]", "stop": r"[.,;:]", "space": r"\s",
}


def statistics(text: Column) -> Column:
    """Struct of statistics over the whole text."""
    text = empty_if_null(text)

    def of(t: Column) -> Column:
        n = F.greatest(F.length(t), F.lit(1))
        shares = [(F.regexp_count(t, F.lit(p)) / n).alias(k) for k, p in SHARES.items()]

        def counted(words: Column) -> Column:
            many = F.greatest(F.size(words), F.lit(1))
            lines = F.regexp_count(t, F.lit("\n")) + 1
            return F.struct(
                F.log1p(F.length(t).cast("double")).alias("length"),
                F.log1p(F.size(words).cast("double")).alias("words"),
                (F.size(F.array_distinct(words)) / many).alias("distinct"),
                (F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / many).alias("word_length"),
                (F.size(words) / lines).alias("words_a_line"),
                *shares)
        return let(F.filter(F.split(t, r"\s+"), lambda w: w != ""), counted)
    return let(text, of)


@dataclass(frozen=True)
class Rule:
    """Conjunction of bounds: statistic -> (above, at most)."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, above, most in self.bounds:
            if above > float("-inf"):
                out = out & (stats[name] > above)
            if most < float("inf"):
                out = out & (stats[name] <= most)
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules; ``score`` is their logistic sum."""

    intercept: float = 0.0
    rules: tuple[tuple[Rule, float], ...] = field(default=())
    rounds: int = 0  # that the lasso took

    def score(self, text: Column) -> Column:
        def logistic(stats: Column) -> Column:
            total = F.lit(self.intercept)
            for rule, weight in self.rules:
                total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(0.0)
            return 1.0 / (1.0 + F.exp(-total))
        return let(statistics(text), logistic)


_STEP = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def tree_rules(debug: str, names: list[str]) -> list[Rule]:
    """Rules of all paths, read from the text form of the trees."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, str, bool, float]] = []
    for line in debug.splitlines():
        step = _STEP.search(line)
        if not step:
            continue
        indent = len(line) - len(line.lstrip())
        while path and path[-1][0] >= indent:
            path.pop()
        path.append((indent, names[int(step[2])], step[3] == ">", float(step[4])))
        bounds: dict[str, list[float]] = {}
        for _, name, above, value in path:
            b = bounds.setdefault(name, [float("-inf"), float("inf")])
            b[0 if above else 1] = max(b[0], value) if above else min(b[1], value)
        found[Rule(tuple(sorted((n, *b) for n, b in bounds.items())))] = None
    return list(found)


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id",
                    text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, statistics...) of at most ``rows`` labelled documents."""
    picked = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
                    .select(F.col(id_col).alias("l_id"), F.col(label_col).cast("double").alias("label"))
                    .orderBy(F.xxhash64("l_id"), "l_id", "label").limit(rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    both = texts.join(broadcast_bounded(picked, rows), F.col("id") == F.col("l_id"))
    return stored(both.select("id", "label", statistics(F.col("text")).alias("s")).select("id", "label", "s.*")
                      .repartition(2, "id").sortWithinPartitions("id", "label"), "sample")


def fit(sample: DataFrame, seed: int = 5) -> RuleEnsemble:
    """Grow trees, read their rules, weigh them with a lasso."""
    names = [c for c in sample.columns if c not in ("id", "label")]
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}  # two classes
    n, good = sum(counts.values()), counts.get(1.0, 0)
    if len(counts) < 2:
        from math import log
        return RuleEnsemble(log((good + 1) / (n - good + 1)))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(sample)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="onethird").fit(rows)
    rules = tree_rules(forest.toDebugString, names)
    table = sample.toArrow().sort_by([("id", "ascending"), ("label", "ascending")])  # at most SAMPLE_ROWS rows
    stats = {c: table[c].to_numpy() for c in names}
    fired = np.stack([np.logical_and.reduce([(stats[c] > above) & (stats[c] <= most) for c, above, most in rule.bounds])
                      for rule in rules], axis=1).astype(float)
    intercept, weights, rounds = lasso_logistic(fired, table["label"].to_numpy(), LASSO)
    return RuleEnsemble(intercept, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w), rounds)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray, int]:
    """(intercept, weights, rounds) that minimise the mean logistic loss plus ``penalty`` times the
    absolute weights, by proximal Newton steps (coordinate descent on the quadratic model, with a line search)."""
    rows, n = np.unique(np.column_stack([y, x]), axis=0, return_counts=True)
    y, x, n = rows[:, 0], np.column_stack([np.ones(len(rows)), rows[:, 1:]]), n / n.sum()
    bound = np.full(x.shape[1], penalty)
    bound[0] = 0.0  # the intercept is free
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(n @ (np.logaddexp(0, z) - y * z) + bound @ np.abs(w))
    for rounds in range(MOST_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (n * (p - y))
        off = np.where(w != 0, np.abs(slope + bound * np.sign(w)), np.maximum(np.abs(slope) - bound, 0))
        if off.max() < TOLERANCE:
            return float(w[0]), w[1:], rounds
        curve = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-10 * np.eye(len(w))
        to, pull = w.copy(), np.zeros(len(w))  # pull: curve @ (to - w)
        for _ in range(1000):
            most = 0.0
            for j in np.flatnonzero((to != 0) | (np.abs(slope + pull) >= bound)).tolist():
                a = curve[j, j]
                free = to[j] - (slope[j] + pull[j]) / a
                new = np.sign(free) * max(abs(free) - bound[j] / a, 0.0)
                if new != to[j]:
                    pull += curve[:, j] * (new - to[j])
                    most, to[j] = max(most, a * abs(new - to[j])), new
            if most < 0.01 * TOLERANCE:
                break
        step, now = 1.0, loss(w)
        while step > 1e-10 and loss(w + step * (to - w)) > now:
            step /= 2
        w = to if step == 1.0 else w + step * (to - w)
    return float(w[0]), w[1:], MOST_ROUNDS


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    sample = training_sample(docs, labels, label_col, id_col, text_col, rows)
    model = fit(sample)
    forget(sample)
    return model
