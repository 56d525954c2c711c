"""Quality classifier: a sparse ensemble of rules (operator 1).

A random forest of shallow trees learns on statistics of a bounded labelled sample. Every path of
a tree to one of its nodes is a rule, a conjunction of thresholds. A lasso logistic regression over
all rules keeps a few with weights, and these are compiled into one Spark column expression that
scores all documents.

Defined results: null and empty texts are scored by their statistics, which are 0; without labels
the score is 0.5, with labels of one class only it is that class; rows without a doc_id are scored
but never learnt from; rows that repeat are scored each; other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored
from ledgerframe.llm.text_stats import FEATURES, features, held_out, labelled_sample, with_counts, without_counts

#: Labelled documents that the model learns from, at most.
MAX_SAMPLE = 20_000
#: A document is predicted good from this score on.
THRESHOLD = 0.3

#: (feature, is it above the threshold, threshold)
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, values: dict[str, Column]) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(condition(rule, values), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def condition(rule: tuple[Condition, ...], values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for name, above, at in rule:
        out = out & ((values[name] > at) if above else (values[name] <= at))
    return out


def _simplest(path: list[Condition]) -> tuple[Condition, ...]:
    """One bound a side: the strictest."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, above, at in path:
        old = bounds.get((name, above), at)
        bounds[name, above] = max(old, at) if above else min(old, at)
    return tuple(sorted((n, a, t) for (n, a), t in bounds.items()))


def tree_rules(forest) -> list[tuple[Condition, ...]]:
    """The rules on the paths of all trees, each once."""
    found: dict[tuple[Condition, ...], None] = {}

    def walk(node, path: list[Condition]) -> None:
        if path:
            found.setdefault(_simplest(path))
        if "InternalNode" in node.getClass().getSimpleName():
            split = node.split()
            name, at = FEATURES[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), [*path, (name, False, at)])
            walk(node.rightChild(), [*path, (name, True, at)])

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), [])
    return list(found)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = MAX_SAMPLE, trees: int = 20, depth: int = 4, penalty: float = 0.0005) -> RuleModel:
    counted = with_counts(labelled_sample(docs.select("doc_id", text), labels, most), text)
    values = features()
    sample = stored(counted.select("label", *[values[f].alias(f) for f in FEATURES]), "sample")
    total, good = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("label") > 0).cast("int")), F.lit(0))).first()
    if not total:
        return RuleModel(0.0, ())
    if good in (0, total):
        return RuleModel(30.0 if good else -30.0, ())
    seen = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(sample).select("x", *FEATURES, (F.col("label") > 0).cast("double").alias("y")).coalesce(8)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=7).fit(seen)
    rules = tree_rules(forest)
    columns = {f: F.col(f) for f in FEATURES}
    held = seen.select("y", F.array(*[condition(r, columns).cast("double") for r in rules]).alias("r"))
    lasso = LogisticRegression(featuresCol="v", labelCol="y", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
    model = lasso.fit(held.select("y", array_to_vector("r").alias("v")))
    weights = model.coefficients.toArray()
    return RuleModel(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def score(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (older columns of these names are replaced)."""
    counted = with_counts(docs, text)
    scored = without_counts(counted.withColumn("score", model.score(features())))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
