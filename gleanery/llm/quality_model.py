"""Quality classifier as a sparse ensemble of rules.

1. Every text's statistics are Spark columns, computed in one pass over the texts and stored.
2. A random forest of shallow trees is fitted on the labelled rows. Each path from a root is a
   conjunction of conditions on statistics; equal conjunctions are one rule.
3. A logistic regression with a lasso penalty weighs the rules; most weights become 0.
4. What is left is compiled into one column expression: a score needs no model object, and no
   Python on the executors.

All labelled rows are used; both fits are distributed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.once import bound
from gleanery.llm.quality_rules import lines_with_words
from gleanery.llm.words import ink_only, single_spaced, unused, whole, word_count
from gleanery.session import freeze_table, scratch_path

STATISTICS = (
    "words",
    "symbols",
    "exclamations",
    "duplicate_lines",
    "repeats",
    "distinct_words",
    "word_length",
    "stops",
    "digits",
)
TREES, DEPTH, SEED = 12, 4, 20240104
PENALTY = 1e-3


def statistics(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """``keep`` and the statistics of every text; a missing one counts as empty. Rates are per
    word, with one word for a text without any. No column of ``keep`` may be called like a
    statistic; `score_texts` takes any."""
    text = whole(text_column)
    spaced = F.btrim(single_spaced(text))
    again = F.regexp_count(spaced, F.lit(r"(?<![^ ])([^ ]++) (?=\1(?![^ ]))"))
    lines = bound(
        lines_with_words(text),
        lambda x: (F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), F.lit(1)),
    )
    counted = docs.select(
        *keep,
        word_count(text).cast("double").alias("words"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("symbols"),
        F.regexp_count(text, F.lit("!")).alias("exclamations"),
        lines.alias("duplicate_lines"),
        again.alias("repeats"),
        F.size(F.array_distinct(F.split(spaced, " "))).alias("distinct_words"),
        F.length(ink_only(text)).alias("word_length"),
        F.regexp_count(text, F.lit("[.?;:]")).alias("stops"),
        F.regexp_count(text, F.lit("[0-9]")).alias("digits"),
    )
    rates = [n for n in STATISTICS if n not in ("words", "duplicate_lines")]
    return counted.withColumns({n: F.col(n) / F.greatest(F.col("words"), F.lit(1.0)) for n in rates})


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, above, up to) that must all hold."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, upto in self.bounds:
            if above > -math.inf:
                out = out & (F.col(name) > above)
            if upto < math.inf:
                out = out & (F.col(name) <= upto)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{above:g} < {name} <= {upto:g}" for name, above, upto in self.bounds)


def forest_nodes(forest: RandomForestClassificationModel, spark: SparkSession) -> DataFrame:
    """``tree, node, low, high, feature, threshold`` of a forest, as the model is saved: up to the
    threshold the child ``low`` follows, beyond it ``high``. Both are negative at a leaf."""
    path = scratch_path(spark, "forest")
    forest.save(path)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.col("nodeData.leftChild").alias("low"),
        F.col("nodeData.rightChild").alias("high"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )


def tree_rules(nodes: Iterable[tuple[int, int, int, int, int, float]], names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """The rules of all paths of a forest's nodes, each once, in a fixed order."""
    by_key = {(tree, node): split for tree, node, *split in nodes}
    found: set[Rule] = set()
    pending = [(key, {}) for key in by_key if key[1] == 0]
    while pending:
        (tree, node), bounds = pending.pop()
        if bounds:
            found.add(Rule(tuple((n, *bounds[n]) for n in sorted(bounds))))
        low, high, feature, threshold = by_key[tree, node]
        if low < 0:
            continue
        above, upto = bounds.get(names[feature], (-math.inf, math.inf))
        pending.append(((tree, low), {**bounds, names[feature]: (above, min(upto, threshold))}))
        pending.append(((tree, high), {**bounds, names[feature]: (max(above, threshold), upto)}))
    return sorted(found, key=lambda r: r.bounds)


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    weighted: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        """Chance of label 1 as one expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.weighted:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """An ensemble from rows of statistics and a label of 0 or 1. Without both labels every
    score is the share of label 1, or a half without rows."""
    labelled = labelled.filter(F.col(label).isin(0, 1)).select(*STATISTICS, F.col(label).cast("double").alias("label"))
    labelled = freeze_table(labelled, "labelled")
    rows, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, rows):
        share = min(max((ones + 0.5) / (rows + 1.0), 1e-6), 1 - 1e-6)
        return Ensemble(math.log(share / (1 - share)))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(labelled)
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=SEED, subsamplingRate=0.7, featureSubsetStrategy="onethird"
    ).fit(vectors)
    # At most `trees` times 2 ** (depth + 1) nodes.
    rules = tree_rules(tuple(n) for n in forest_nodes(forest, labelled.sparkSession).collect())
    if not rules:
        return Ensemble(math.log(ones / (rows - ones)))
    flags = labelled.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    inputs = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features")
    flagged = freeze_table(inputs.transform(flags).select("label", "features"), "rules")
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, tol=1e-5).fit(flagged)
    weights = lasso.coefficients.toArray()
    kept = tuple((r, float(w)) for r, w in zip(rules, weights) if w)
    return Ensemble(float(lasso.intercept), kept)


def score_texts(
    docs: DataFrame,
    labels: DataFrame,
    keep: list[str],
    id_column: str = "doc_id",
    label_column: str = "quality",
    text_column: str = "text",
) -> DataFrame:
    """``keep`` and ``score`` of every row of ``docs``. ``labels`` (id, label) has the rows to
    learn from; missing labels and ids teach nothing, rows that repeat teach as often. A kept
    column called ``score`` comes as ``score_``."""
    held = {f"_keep{i}": name for i, name in enumerate(keep)}
    named = docs.select(
        F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), *[F.col(c).alias(h) for h, c in held.items()]
    )
    rows = freeze_table(statistics(named, ["_id", *held], "_text"), "statistics")
    known = labels.select(F.col(id_column).alias("_id"), F.col(label_column).alias("label"))
    model = fit(rows.join(known, "_id"))
    return rows.select(*[F.col(h).alias(unused(["score"], c)) for h, c in held.items()], model.score().alias("score"))
