"""Quality scores from a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewell.session import stage

# Labelled rows that a model is fitted on at most; the labels of smallest hash are taken.
MAX_TRAINING_ROWS = 20_000
_PARTITION_ROWS = 5_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"
_STOPS = ".,;:?"
_MARKS = "!\"#$%&()*+-/<=>@[\\]^_`{|}~"
_SPACE = "\t\n\x0b\x0c\r"


def text_statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by name; a null or empty text has zero in all of them."""
    text = F.coalesce(text, F.lit(""))
    n = F.char_length(text)
    words = F.array_remove(F.split(F.translate(text, _SPACE, " " * len(_SPACE)), " "), "")

    def count_of(chars: str) -> Column:
        return n - F.char_length(F.translate(text, chars, ""))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    return {
        "log_chars": F.log1p(n),
        "log_words": F.log1p(F.size(words)),
        "word_length": share(n, F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "upper": share(count_of(_UPPER), n),
        "digits": share(count_of(_DIGITS), n),
        "stops": share(count_of(_STOPS), n),
        "marks": share(count_of(_MARKS), n),
        "line_feeds": share(count_of("\n"), n),
        "bytes": share(F.octet_length(text), n),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction ``low < statistic <= high`` over some statistics, with its weight."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def holds(self, of) -> Column:
        """The conjunction as a column; ``of`` gives the column of a statistic."""
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -math.inf:
                out = out & (of(name) > low)
            if high < math.inf:
                out = out & (of(name) <= high)
        return out


@dataclass(frozen=True)
class RuleModel:
    """Rules with their weights; a score is the logistic function of the sum of those that hold."""

    rules: tuple[Rule, ...]
    intercept: float

    def score(self, text: Column) -> Column:
        """Score of a whole text between 0 and 1 as a column, each statistic computed once."""
        if not self.rules:
            return F.lit(1 / (1 + math.exp(-self.intercept)))
        known = F.struct(*[c.cast("double").alias(name) for name, c in text_statistics(text).items()])

        def of_statistics(s: Column) -> Column:
            total = F.lit(self.intercept)
            for rule in self.rules:
                total = total + F.when(rule.holds(lambda name: s[name]), F.lit(rule.weight)).otherwise(0.0)
            return 1 / (1 + F.exp(-total))

        # The statistics are bound once here, also where the optimizer copies the score into a filter.
        return F.transform(F.array(known), of_statistics)[0]


def _paths(node, names: list[str], bounds: dict[str, tuple[float, float]]) -> Iterator[tuple]:
    """Bounds of the path to every node below a tree's root."""
    if bounds:
        yield tuple((k, *bounds[k]) for k in sorted(bounds))
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    name, at = names[split.featureIndex()], float(split.threshold())
    low, high = bounds.get(name, (-math.inf, math.inf))
    yield from _paths(node.leftChild(), names, bounds | {name: (low, min(high, at))})
    yield from _paths(node.rightChild(), names, bounds | {name: (max(low, at), high)})


def training_labels(
    labels: DataFrame, id_col: str, label_col: str, keep: Column | None, max_rows: int
) -> DataFrame:
    """At most ``max_rows`` rows ``(id, y)``; an id with two different labels or none is left out."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if keep is not None:
        rows = rows.where(keep)
    one = rows.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("top"))
    return one.where("y = top").orderBy(F.xxhash64("id"), "id").limit(max_rows).select("id", F.col("y").cast("double"))


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    keep: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_TRAINING_ROWS,
    trees: int = 30,
    depth: int = 3,
    penalty: float = 0.001,
) -> RuleModel:
    """Fit a rule ensemble on whole labelled texts, at most ``max_rows`` of them.

    A forest of shallow trees proposes rules, one for every path to a node; lasso logistic
    regression over the rules' truth values keeps few of them and weighs them. ``keep`` filters
    the labels (a held-out set). Only the text is looked at. With one class or no labelled
    rows the model has no rules and scores the share of label 1, at one half without rows.
    """
    chosen = stage(training_labels(labels, id_col, label_col, keep, max_rows), "training_labels")
    statistics = text_statistics(F.col("text"))
    names = list(statistics)
    # The labels are bounded by max_rows, so they can be sent to every task of the text scan.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = stage(texts.select("y", *[c.cast("double").alias(k) for k, c in statistics.items()]), "training_statistics")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    positive, n = counts.get(1.0, 0), sum(counts.values())
    if len(counts) < 2:
        return RuleModel((), math.log((positive + 1) / (n - positive + 1)))
    rows = rows.repartition(-(-n // _PARTITION_ROWS)).cache()
    forest = RandomForestClassifier(
        labelCol="y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=7, maxBins=64
    ).fit(rows.select("y", array_to_vector(F.array(*names)).alias("features")))
    found = {p for tree in forest.trees for p in _paths(tree._call_java("rootNode"), names, {})}
    rules = [Rule(bounds) for bounds in sorted(found)]
    truth = F.array(*[r.holds(F.col).cast("double") for r in rules])
    lasso = LogisticRegression(
        labelCol="y", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60
    ).fit(rows.select("y", array_to_vector(truth).alias("features")).cache())
    rows.unpersist()
    weights = lasso.coefficients.toArray()
    kept = tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, weights) if w)
    return RuleModel(kept, float(lasso.intercept))
