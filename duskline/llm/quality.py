"""Quality of a text by a sparse ensemble of rules over simple statistics.

The paths of shallow trees become rules, each a conjunction of bounds on statistics.
A lasso logistic regression weighs them and drops most. The rules that are left
are compiled into one Spark column expression, so scoring never leaves the JVM.

Defined cases: a null text is empty; all statistics of an empty text are 0; rows
with a null id or label, and ids with both labels, are not learned from; without
rows of both labels the score is the share of label 1, or 0; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from duskline.llm.common import held_out
from duskline.llm.toxicity import labelled_sample

# At most so many labelled documents of each class are learned from.
SAMPLE = {0: 10_000, 1: 10_000}
TREES, DEPTH, LASSO = 24, 3, 0.002
PREDICTED_FROM = 0.3
WORDS = r"[\x20\x09-\x0D]+"

_LINE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)$")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; shares of its characters, words or lines."""
    clean = F.trim(F.regexp_replace(text, WORDS, " "))
    words = F.filter(F.split(clean, " "), lambda w: w != "")
    lines = F.split(text, "\n")
    n_chars, n_words = F.length(text), F.size(words)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def chars(pattern: str) -> Column:
        return share(F.regexp_count(text, F.lit(pattern)), n_chars)

    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": share(F.length(clean) - n_words, n_words),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_length": share(n_words, F.size(lines)),
        "upper": chars(r"\p{Lu}"),
        "digits": chars(r"\p{Nd}"),
        "symbols": chars(r"[^\p{L}\p{Nd}\s.,;:'\"?!()-]"),
        "shouts": chars("!"),
        "stops": chars("[.?]"),
        "commas": chars(","),
    }


@dataclass(frozen=True)
class Rule:
    """Holds where every ``(statistic, is_greater, bound)`` holds."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        held = F.lit(True)
        for name, greater, bound in self.parts:
            held = held & (F.col(name) > bound if greater else F.col(name) <= bound)
        return held.cast("double")


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[Rule, float], ...]
    constant: float
    share: float | None = None

    def score(self) -> Column:
        """Probability of label 1, over columns named as the statistics."""
        if self.share is not None:
            return F.lit(self.share)
        line = sum((F.lit(w) * rule.column() for rule, w in self.rules), F.lit(self.constant))
        return 1 / (1 + F.exp(-line))


def tree_rules(printed: str, names: list[str]) -> list[Rule]:
    """The conjunctions on the way to every node of printed trees, without doubles.

    Of several bounds on one statistic in the same direction the tightest is kept.
    """
    rules: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in printed.splitlines():
        if not (found := _LINE.match(line)):
            if line.lstrip().startswith("Tree"):
                path = []
            continue
        indent = len(found[1])
        path = [p for p in path if p[0] < indent]
        path.append((indent, (names[int(found[3])], found[4] == ">", float(found[5]))))
        tight: dict[tuple[str, bool], float] = {}
        for _, (name, greater, bound) in path:
            key = (name, greater)
            other = tight.get(key, bound)
            tight[key] = max(bound, other) if greater else min(bound, other)
        rules[Rule(tuple(sorted((n, g, b) for (n, g), b in tight.items())))] = None
    return list(rules)


def learn_quality(docs: DataFrame, labels: DataFrame, size: dict[int, int] = SAMPLE) -> RuleModel:
    """Rules and weights from at most ``size`` labelled documents of each class.

    The classes are weighted back to their shares among all labels, so the score
    stays a probability however the sample was cut.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = list(statistics(text))
    # Bounded by ``size``: rows of two numbers.
    sample = F.broadcast(labelled_sample(labels, "quality", size))
    rows = docs.select("doc_id", text.alias("text")).join(sample, "doc_id")
    table = rows.select(
        F.col("label").cast("double"), *[c.alias(n) for n, c in statistics(F.col("text")).items()]
    )
    counted = {row["label"]: row["count"] for row in table.groupBy("label").count().collect()}
    whole = {
        row["quality"]: row["count"]
        for row in labels.where(F.col("quality").isin(0, 1)).groupBy("quality").count().collect()
    }
    if len(counted) < 2:
        rows_found = sum(counted.values())
        return RuleModel((), 0.0, counted.get(1.0, 0) / rows_found if rows_found else 0.0)
    weight = {y: whole[int(y)] / counted[y] for y in counted}
    table = table.withColumn(
        "weight", F.when(F.col("label") == 1, weight[1.0]).otherwise(weight[0.0])
    ).persist()
    try:
        points = VectorAssembler(inputCols=names, outputCol="features").transform(table)
        forest = RandomForestClassifier(
            numTrees=TREES, maxDepth=DEPTH, seed=7, weightCol="weight", subsamplingRate=0.7
        ).fit(points)
        rules = tree_rules(forest.toDebugString, names)
        if not rules:
            return RuleModel((), 0.0, whole[1] / (whole[0] + whole[1]))
        held = table.select(
            "label", "weight", *[rule.column().alias(f"r{i}") for i, rule in enumerate(rules)]
        )
        columns = [f"r{i}" for i in range(len(rules))]
        fitted = LogisticRegression(
            weightCol="weight", elasticNetParam=1.0, regParam=LASSO, maxIter=60
        ).fit(VectorAssembler(inputCols=columns, outputCol="features").transform(held))
    finally:
        table.unpersist()
    weights = fitted.coefficients.toArray().tolist()
    kept = tuple((rule, w) for rule, w in zip(rules, weights) if w != 0.0)
    return RuleModel(kept, float(fitted.intercept))


def score_quality(docs: DataFrame, model: RuleModel, *keep: Column) -> DataFrame:
    """``keep`` columns, then ``score`` (0 to 1) and ``predicted`` (1 from 0.3 on)."""
    shown = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_text"), *keep)
    kept = shown.columns[1:]
    named = shown.select(*kept, *[c.alias(n) for n, c in statistics(F.col("_text")).items()])
    scored = named.select(*kept, model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The quality of every document, learned from labels of those that are not held out."""
    out = held_out(F.col("doc_id"), 5, 0)
    model = learn_quality(docs, labels.where(~out))
    return score_quality(docs, model, F.col("doc_id"), out.alias("held_out"))
