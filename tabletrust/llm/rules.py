"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees of a random forest are cut into their paths, each path a conjunction of limits on statistics. A lasso logistic
regression weighs the rules and leaves most at zero; the others are compiled into one column expression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrust.llm.common import saved
from tabletrust.llm.quality import dup_lines, repeated

#: Most labelled rows that the rules are fitted on; those with the smallest hashes of the id are taken.
SAMPLE = 20_000
TREES, DEPTH, LASSO = 12, 3, 0.002
STATS = ["n_words", "word_len", "symbols", "upper", "digits", "pipes", "marks", "letters", "dup_lines", "repeats", "distinct", "line_words", "commas", "ended"]


def measured(text: str) -> tuple[float, ...]:
    """The statistics of one whole text, in the order of STATS; an empty text is all zeros."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return (0.0,) * len(STATS)
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, of = len(words), lambda chars: float(c[list(chars.encode())].sum())
    upper, lower = float(c[65:91].sum()), float(c[97:123].sum() + c[192:].sum())
    size = sum(map(len, words))
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    return (
        math.log1p(n), size / n, of("#*$%&<>") / n, upper / max(1.0, upper + lower), float(c[48:58].sum()) / size, of("|") / n, of("!?") / n, (upper + lower) / size,
        dup_lines(text) / max(1, len(full)), repeated(words) / n, len(set(words)) / n, math.log1p(n / max(1, len(full))), of(",") / n, sum(x.rstrip()[-1] in ".!?" for x in full) / max(1, len(full)),
    )


def with_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and the statistics of each whole text (null: empty)."""
    columns = docs.select(*keep, F.col(text).alias("_text"))
    shaped = columns.select(*keep, *(F.lit(0.0).alias(s) for s in STATS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                found = np.array([measured(t or "") for t in part.column(part.num_columns - 1).to_pylist()]).reshape(-1, len(STATS))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(found[:, i]) for i in range(len(STATS)))], names=[*keep, *STATS])

    return columns.mapInArrow(run, shaped.schema)


Rule = tuple[tuple[int, bool, float], ...]


def paths(text: str) -> list[Rule]:
    """The paths of a printed forest, from the root to every node: (feature, whether at most the limit, limit) each."""
    found: set[Rule] = set()
    stack: list[tuple[int, tuple[int, bool, float]]] = []
    for line in text.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            if line.strip().startswith("Tree"):
                stack = []
            continue
        depth = len(m[1])
        stack = [(d, t) for d, t in stack if d < depth] + [(depth, (int(m[3]), m[4] == "<=", float(m[5])))]
        found.add(tuple(t for _, t in stack))
    return sorted(found)


def condition(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [(F.col(STATS[f]) <= limit) if most else (F.col(STATS[f]) > limit) for f, most, limit in rule])


class RuleModel:
    """Rules, their weights and the bias; score is their column expression over STATS."""

    def __init__(self, rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO):
        """rows: label (0 or 1) and STATS. With one kind of label only, the score is that label; without rows, one half."""
        counts = {int(r.label): r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        self.rules: list[tuple[Rule, float]] = []
        if len(counts) < 2:
            self.bias = 0.0
            self.score = F.lit(float(next(iter(counts))) if counts else 0.5)
            return
        vectors = VectorAssembler(inputCols=STATS, outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double")))
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=1, featureSubsetStrategy="onethird").fit(vectors.select("features", "label"))
        rules = paths(forest.toDebugString)
        fired = rows.select(F.col("label").cast("double").alias("label"), F.array(*(condition(r).cast("double") for r in rules)).alias("fired"))
        from pyspark.ml.functions import array_to_vector

        lasso_fit = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=60, standardization=False).fit(fired.select("label", array_to_vector("fired").alias("features")))
        weights = lasso_fit.coefficients.toArray()
        self.bias = float(lasso_fit.intercept)
        self.rules = [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9]
        margin = reduce(lambda a, b: a + b, [F.when(condition(r), w).otherwise(0.0) for r, w in self.rules], F.lit(self.bias))
        self.score = 1 / (1 + F.exp(-margin))


def fit(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> RuleModel:
    """Fits on at most `sample` labelled rows. docs: doc_id, text; labels: doc_id and the label."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label")).distinct()
    taken = saved(known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")  # `sample` rows of two numbers
    return RuleModel(saved(with_stats(rows, ["label"]), "stats"))


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id and score for each row of docs.

    Null texts count as empty, and an empty text has a score too; texts of any length are read whole. Repeated rows and
    rows with equal or null ids are scored each; an empty table gives no rows. Other columns of docs aren't read.
    """
    return with_stats(docs, ["doc_id"]).select("doc_id", model.score.alias("score"))
