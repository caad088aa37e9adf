"""Quality by a sparse rule ensemble over text statistics, scored by Spark column expressions alone.

Statistics are native columns over a document's whole text. Boosted trees fitted on labelled documents give
candidate rules, each the conjunction along a path from the root; a lasso logistic regression keeps few of them, and
the score is the logistic of their weighted sum, compiled into one column expression. No Python runs on executors and
nothing is shuffled for scoring.

The fit uses statistics (not texts) of a bounded sample of labelled rows: `limit` rows of each class, lowest hashes
first; where the bound changes the share of good rows, the intercept is shifted to the share over all training
labels, so scores and cuts mean the same at each table size. Nulls: a null text is empty; null labels and labels of unknown ids don't train; without both classes the
score is the share of good labels, or 1 without labels, so that nothing is rejected unlearnt. Empty and very long
texts, ties and repeated rows are scored alike; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm import trees
from wavelake.llm.common import held_out, training_ids

#: Labelled documents of each class that the fit sees at most.
LIMIT = 8_000
ROUNDS, DEPTH = 24, 3
#: Lasso's weight, in units of the mean log loss.
LASSO = 1e-3
STATISTICS = ("log_words", "distinct_share", "repeat_share", "upper_share", "symbol_share", "bar_share", "stop_share", "digit_share", "word_length", "line_repeat_share", "bang_share")


def statistics(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `extra` and one double for each of STATISTICS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, text.alias("_t"))
    d = d.withColumn("_w", F.filter(F.split("_t", "[ \\n\\t\\r]+"), lambda w: w != ""))
    n_chars, n_words = F.greatest(F.length("_t"), F.lit(1)), F.size("_w")
    some = F.greatest(n_words, F.lit(1))
    without = lambda pattern: F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))
    lacking = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    again = F.size(F.filter(F.zip_with("_w", F.slice("_w", 2, F.greatest(n_words, F.lit(1))), lambda a, b: a == b), lambda x: x))
    lines = F.filter(F.split("_t", "\\n"), lambda x: F.length(x) > 0)
    d = d.withColumn("_l", lines)
    columns = {
        "log_words": F.log1p(n_words),
        "distinct_share": F.size(F.array_distinct("_w")) / some,
        "repeat_share": again / some,
        "upper_share": without("\\p{Lu}+") / n_chars,
        "symbol_share": lacking("#$%&*@^~<>{}=+_") / n_chars,
        "bar_share": lacking("|\\/") / n_chars,
        "stop_share": lacking(".,;:?") / n_chars,
        "digit_share": lacking("0123456789") / n_chars,
        "word_length": F.length("_t") / some,
        "line_repeat_share": (F.size("_l") - F.size(F.array_distinct("_l"))) / F.greatest(F.size("_l"), F.lit(1)),
        "bang_share": lacking("!") / n_chars,
    }
    return d.select("doc_id", *extra, *[columns[k].cast("double").alias(k) for k in STATISTICS])


def sample(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Statistics and labels of the training rows, and the shift of training_ids()."""
    spark = docs.sparkSession
    ids, shift = training_ids(labels, "quality", limit)
    if not ids:
        return np.zeros((0, len(STATISTICS))), np.zeros(0), 0.0
    wanted = spark.createDataFrame(ids, "doc_id long, y int")
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id"), ("y",)).orderBy("doc_id").drop("doc_id").collect()
    return np.array([r[1:] for r in rows], float).reshape(len(rows), len(STATISTICS)), np.array([r[0] for r in rows], float), shift


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, cut, up in rule:
        out &= (x[:, j] <= cut) if up else (x[:, j] > cut)
    return out


def lasso(r: np.ndarray, y: np.ndarray, weight: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for logistic loss and an absolute penalty; the intercept is free."""
    m = np.hstack([r, np.ones((len(r), 1))])
    w = v = np.zeros(m.shape[1])
    rate = 4 * len(m) / max(np.linalg.norm(m, 2) ** 2, 1e-9)
    t = 1.0
    for _ in range(steps):
        g = m.T @ (trees.sigmoid(m @ v) - y) / len(m)
        new = v - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * weight, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> dict:
    """rules with weights, and the intercept."""
    x, y, shift = sample(docs, labels, limit)
    if not len(y) or y.min() == y.max():
        return {"rules": [], "base": 40.0 if not len(y) or y.min() == 1 else -40.0}
    _, grown = trees.fit(x, y, ROUNDS, DEPTH, least=max(3, len(y) // 400))
    rules = list(dict.fromkeys(p for tree in grown for p in trees.paths(tree)))
    made = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    weights, base = lasso(made, y, LASSO)
    return {"rules": [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4], "base": base + shift}


def score(model: dict) -> Column:
    """The logistic of the rules' weighted sum, over the columns of statistics()."""
    z = F.lit(model["base"])
    for rule, weight in model["rules"]:
        met = F.lit(True)
        for j, cut, up in rule:
            c = F.col(STATISTICS[j])
            met = met & ((c <= cut) if up else (c > cut))
        z = z + F.when(met, F.lit(weight)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = LIMIT, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, extra, held_out, score, predicted) of every document."""
    s = statistics(docs, extra)
    s = s.select("doc_id", *extra, score(fit(docs, labels, limit)).alias("score"))
    return s.select("doc_id", *extra, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
