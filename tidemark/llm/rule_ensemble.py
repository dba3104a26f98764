"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are grown on labelled texts; every path from a root becomes a conjunctive rule over statistics; a logistic
regression with lasso penalty weighs the rules and drops most of them. The rest is one Spark column expression.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stage, with_python_column

#: What a text is judged by, in the order of the array that with_statistics() gives.
STATISTICS = ("log_words", "word_bytes", "symbols", "capitals", "exclaims", "digits", "distinct", "commonest", "again", "bars", "repeated_lines", "line_words", "other")
_SYMBOLS, _CAPITALS, _DIGITS = b"#*$%&|<>{}[]~^_=+@\\", bytes(range(65, 91)), b"0123456789"
_PLAIN = bytes(range(97, 123)) + _CAPITALS + bytes(range(128, 256)) + b" \n.,"


def _of(text: bytes | None) -> list[float]:
    words = text.split() if text else []
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(text)
    share = lambda some: (size - len(text.translate(None, some))) / size
    counts = Counter(words)
    lines = [x for x in (line.strip() for line in text.split(b"\n")) if x]
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, share(_SYMBOLS), share(_CAPITALS), text.count(b"!") / size, share(_DIGITS), len(counts) / n,
        counts.most_common(1)[0][1] / n, sum(map(eq, words, words[1:])) / n, counts[b"|"] / n, 1 - len(set(lines)) / len(lines), n / len(lines), 1 - share(_PLAIN),
    ]


def with_statistics(rows: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """rows with STATISTICS of the whole text as an array of doubles in column `name`; all 0 for a null or blank text."""
    return with_python_column(rows, name, "array<double>", [F.col(text_col).cast("binary")], _of)


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules are conjunctions of (statistic's place, above threshold or not, threshold)."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[int, bool, float], ...], float], ...]

    def score(self, stats: Column) -> Column:
        """The probability of label 1, from the array of statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule, stats), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _holds(rule: tuple[tuple[int, bool, float], ...], stats: Column) -> Column:
    out = F.lit(True)
    for place, above, threshold in rule:
        own = stats.getItem(place)
        out = out & ((own > float(threshold)) if above else (own <= float(threshold)))
    return out


def _paths(node, path: tuple = ()) -> Iterator[tuple]:
    """Every path from the root, as conditions on statistics."""
    if path:
        yield path
    if node.subtreeDepth():
        place, threshold = node.split().featureIndex(), node.split().threshold()
        yield from _paths(node.leftChild(), (*path, (place, False, threshold)))
        yield from _paths(node.rightChild(), (*path, (place, True, threshold)))


def _tightest(path: tuple) -> tuple:
    """One condition for each statistic and side."""
    best: dict[tuple[int, bool], float] = {}
    for place, above, threshold in path:
        own = best.get((place, above), threshold)
        best[place, above] = max(own, threshold) if above else min(own, threshold)
    return tuple(sorted((place, above, threshold) for (place, above), threshold in best.items()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, trees: int = 12, depth: int = 3, lasso: float = 0.0005, seed: int = 7) -> RuleEnsemble:
    """A rule ensemble from docs (doc_id, text) and labels (doc_id and the label, 0 or 1).

    It is fitted on about max_rows labelled ids, chosen by a hash, so what it gathers is bounded whatever the tables'
    size; that is also the bound of what is broadcast. Ids that are labelled twice count as 1 if at least half their
    labels are; null labels and ids count not at all. Without labels of both kinds the score is a constant.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("mean"))
    known = known.select("doc_id", F.when(F.col("mean") >= 0.5, 1.0).otherwise(0.0).alias("label"))
    n = known.count()
    fraction = min(1.0, max_rows / n) if n else 0.0
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = stage(known.where(place < fraction), "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = stage(with_statistics(rows, "stats").select("label", "stats"), "training").coalesce(4)
    zeros, ones = (rows.where(F.col("label") == x).count() for x in (0.0, 1.0))
    if not zeros or not ones:
        odds = (ones + 1) / (zeros + 1)
        return RuleEnsemble(float(np.log(odds)), ())
    grown = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=seed)
    forest = grown.fit(rows.select("label", array_to_vector("stats").alias("features")))
    rules = sorted({_tightest(p) for tree in forest.trees for p in _paths(tree._call_java("rootNode"))})
    held = F.array(*[F.when(_holds(r, F.col("stats")), 1.0).otherwise(0.0) for r in rules])
    weigh = LogisticRegression(featuresCol="features", labelCol="label", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60)
    model = weigh.fit(rows.select("label", array_to_vector(held).alias("features")))
    weights = model.coefficients.toArray()
    return RuleEnsemble(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def remainder(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(-1)).cast("int")


def fit_seen(docs: DataFrame, labels: DataFrame, folds: int = 5, **how) -> RuleEnsemble:
    """fit() on the labels that aren't held out: those whose id has a remainder other than 0."""
    return fit(docs, labels.where(remainder(F.col("doc_id"), folds) != 0), **how)


def scored(docs: DataFrame, model: RuleEnsemble, score_col: str = "score") -> DataFrame:
    """docs with the model's score of each text, null and blank ones too. A column of docs with that name is replaced."""
    return with_statistics(docs, "_tm_statistics").withColumn(score_col, model.score(F.col("_tm_statistics"))).drop("_tm_statistics")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, score_col: str = "score", predicted_col: str = "predicted", **how) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0) for every row; labels whose id has
    remainder 0 are held out. Null and blank texts have a score like others. Columns of docs with these
    two names are replaced."""
    rows = scored(docs, fit_seen(docs, labels, folds, **how), score_col)
    return rows.withColumn(predicted_col, F.when(F.col(score_col) >= threshold, 1).otherwise(0))
