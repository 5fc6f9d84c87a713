"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Small boosted trees over the statistics of labelled documents are grown on the
driver; every path from a root to a node is a rule, a conjunction of comparisons.
A logistic regression with an l1 penalty over all rules leaves weights to few of
them, and these are compiled into one column expression, so that scoring runs as
generated code without Python. Statistics are column expressions as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most labelled documents that the model is fitted to: those with the smallest hash of doc_id.
MOST_LABELLED = 20_000
FOLDS, THRESHOLD = 5, 0.3
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 40, 3, 48, 0.3, 20
PENALTIES = (0.03, 0.01, 0.003, 0.001)


def statistics(text: Column) -> dict[str, Column]:
    """Statistics by name; a null text counts as empty. Each is 0 or more, never null."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n_words, n_chars, n_lines = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(text), F.lit(1)), F.size(lines)

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    return {
        "chars": F.length(text).cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": n_chars / n_words,
        "line_words": n_words / n_lines,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "capitals": count(r"\p{Lu}") / n_chars,
        "digits": count("[0-9]") / n_chars,
        "stops": count("[.!?]") / n_words,
        "commas": count("[,;:]") / n_words,
        "exclamations": count("!") / n_words,
        "bars": count(r"[|]") / n_words,
        "symbols": count("[#$%&*+=<>@^_~{}\\\\\\[\\]]") / n_words,
        "symbol_runs": count("[#$%&*+=<>@^_~]{2,}") / n_words,
    }


@dataclass(frozen=True)
class Rule:
    """parts: (statistic, whether it must be above, bound), all of which must hold; weight: what it adds to the log odds."""

    parts: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[Rule, ...]

    def expression(self, columns: dict[str, Column]) -> Column:
        """The score, from 0 to 1, as one column."""
        total = F.lit(float(self.bias))
        for rule in self.rules:
            holds = F.lit(True)
            for name, above, bound in rule.parts:
                holds = holds & ((columns[name] > F.lit(bound)) if above else (columns[name] <= F.lit(bound)))
            total = total + F.when(holds, F.lit(float(rule.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: tuple, paths: list, step: np.ndarray, depth: int) -> None:
    """Grows a tree below path over rows of binned x; adds the paths of its nodes and sets the leaves' steps."""
    value = gradient[rows].sum() / (weight[rows].sum() + 1.0)
    step[rows] = value
    if depth == 0 or len(rows) < 2 * LEAST_ROWS:
        return
    best = (1e-6, None, None)
    whole = gradient[rows].sum() ** 2 / (weight[rows].sum() + 1.0)
    for k in range(x.shape[1]):
        n = np.bincount(x[rows, k], minlength=BINS + 1).cumsum()[:-1]
        g = np.bincount(x[rows, k], gradient[rows], BINS + 1).cumsum()[:-1]
        h = np.bincount(x[rows, k], weight[rows], BINS + 1).cumsum()[:-1]
        g_all, h_all = gradient[rows].sum(), weight[rows].sum()
        gain = g**2 / (h + 1.0) + (g_all - g) ** 2 / (h_all - h + 1.0) - whole
        gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = -1
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (gain[at], k, at)
    if best[1] is None:
        return
    _, k, at = best
    for above in (False, True):
        own = (*path, (k, above, float(cuts[k][at])))
        paths.append(own)
        side = x[rows, k] > at
        _grow(x, gradient, weight, cuts, rows[side == above], own, paths, step, depth - 1)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression with an l1 penalty by accelerated proximal steps; the bias is free."""
    n, m = z.shape
    centre = z.mean(0)
    size = 4.0 / (np.linalg.norm(np.column_stack([z - centre, np.ones(n)]), 2) ** 2 / n)
    w, bias, v, v_bias, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-((z - centre) @ v + v_bias))) - y
        new = v - size * ((z - centre).T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        new_bias, t_new = v_bias - size * error.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return float(bias - centre @ w), w


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """x: statistics of labelled documents; y: their labels, 0 or 1. Without both labels the score is constant."""
    if len(y) == 0 or y.min() == y.max():
        return Model(0.0 if len(y) == 0 else (4.0 if y.max() == 1 else -4.0), ())
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    cuts = [np.pad(c, (0, BINS - len(c)), mode="edge") for c in cuts]
    binned = np.column_stack([np.searchsorted(np.unique(c), x[:, k], "left") for k, c in enumerate(cuts)])
    odds, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        step = np.zeros(len(y))
        _grow(binned, y - p, p * (1 - p), cuts, np.arange(len(y)), (), paths, step, DEPTH)
        odds = odds + RATE * step
    rules = list({frozenset(p): p for p in paths}.values())
    if not rules:
        return Model(float(odds[0]), ())

    def holds(path: tuple) -> np.ndarray:
        out = np.ones(len(y), bool)
        for k, above, bound in path:
            out &= (x[:, k] > bound) == above
        return out

    z = np.column_stack([holds(p) for p in rules]).astype(np.float64)
    kept = np.unique(z, axis=1, return_index=True)[1]  # of rules that hold for the same documents, one
    z, rules = z[:, kept], [rules[k] for k in kept]
    check = np.arange(len(y)) % 4 == 0

    def loss(found: tuple[float, np.ndarray]) -> float:
        p = 1 / (1 + np.exp(-(found[0] + z[check] @ found[1])))
        return float(-np.mean(np.log(np.where(y[check] == 1, p, 1 - p) + 1e-9)))

    penalty = min(PENALTIES, key=lambda c: loss(_lasso(z[~check], y[~check], c)))
    bias, weights = _lasso(z, y, penalty)
    found = [Rule(tuple((names[k], above, bound) for k, above, bound in p), float(w)) for p, w in zip(rules, weights) if abs(w) > 1e-3]
    return Model(bias, tuple(found))


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id's decimal digits is divisible by FOLDS; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fits a model to labels.quality of documents that are not held out.

    docs: doc_id, text; of several rows of one doc_id the one with the smallest
    text counts, where null is empty. labels: doc_id, quality (null: no label;
    several labels of one document: their majority, 1 at a tie). At most `most`
    labelled documents are used, those with the smallest hash of their ids.
    """
    own = labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
    own = own.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a bounded sample, and so fit to be broadcast
    names = list(statistics(F.col("text")))
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = picked.select("doc_id", "label", *[c.alias(n) for n, c in statistics(F.col("text")).items()]).toPandas().sort_values("doc_id")
    return fit(rows[names].to_numpy(np.float64), rows["label"].to_numpy(np.float64), names)


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """docs with the column name: each row's score; a column of that name is replaced. Null texts count as empty."""
    used = {part[0] for rule in model.rules for part in rule.parts}
    kept = [c for c in docs.columns if c != name]
    marked = {n: f"_stat_{n}" for n in used}
    with_stats = docs.select(*kept, *[c.alias(marked[n]) for n, c in statistics(F.col(text)).items() if n in used])
    return with_stats.select(*kept, model.expression({n: F.col(c) for n, c in marked.items()}).alias(name))


def predicted(score_name: str = "score") -> Column:
    return (F.col(score_name) >= THRESHOLD).cast("int")


def op8_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, by rules learnt from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted().alias("predicted"))
