"""Quality classifier: a sparse ensemble of rules.

Shallow boosted trees over statistics of the text propose conjunctions (the paths from a root to
each node); a lasso-penalised logistic regression weighs them and drops most; what is left is
compiled into Spark column expressions, so that scoring is one pass without a model in memory.
Labels, language, source and id are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import docs_of, row_of
from palimpsest.llm.stats import text_stats

#: Labelled rows that the model is fitted on at most, taken by a hash of their id; it scores every row.
FIT_ROWS = 20_000
#: Trees, their depth, the rows of a leaf at least, cuts tried for a statistic, the boosting step.
TREES, DEPTH, LEAF, CUTS, STEP = 60, 3, 20, 24, 0.3
#: The lasso penalty, and rounds of the proximal gradient.
LASSO, ROUNDS = 0.002, 400
#: Score from which a text is predicted to be good.
THRESHOLD = 0.3

Condition = tuple[str, bool, float]  # statistic, whether it is above, the cut


def features() -> dict[str, Column]:
    """The statistics that rules are made of, over the columns of text_stats(); never null."""
    c = F.col
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    letters = c("n_upper") + c("n_lower")
    return {
        "words": c("n_words").cast("double"),
        "word_length": share(c("word_chars"), c("n_words")),
        "longest_word": c("longest_word").cast("double"),
        "symbols": share(c("n_symbols"), c("n_words")),
        "symbol_words": share(c("n_symbol_words"), c("n_words")),
        "same_lines": share(c("n_dup_lines"), c("n_lines")),
        "words_a_line": share(c("n_words"), c("n_lines")),
        "repeated_words": share(c("n_repeat_words"), c("n_words")),
        "unique_words": share(c("n_unique_words"), c("n_words")),
        "capitals": share(c("n_upper"), letters),
        "digits": share(c("n_digits"), c("word_chars")),
        "exclaims": share(c("n_excl"), c("n_words")),
        "sentence_ends": share(c("n_ends"), c("n_words")),
        "commas": share(c("n_commas"), c("n_words")),
    }


@dataclass(frozen=True)
class RuleModel:
    """A weighted sum of conjunctions, read as log odds of a good text."""

    bias: float
    rules: list[tuple[float, tuple[Condition, ...]]] = field(default_factory=list)

    def score(self, columns: dict[str, Column]) -> Column:
        """The probability of a good text, as one expression."""
        odds = F.lit(self.bias)
        for weight, conditions in self.rules:
            holds = reduce(and_, [columns[f] > cut if above else columns[f] <= cut for f, above, cut in conditions])
            odds = odds + F.when(holds, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-odds))


def _holds(x: np.ndarray, names: list[str], conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, cut in conditions:
        v = x[:, names.index(f)]
        out &= v > cut if above else v <= cut
    return out


def _paths(x: np.ndarray, names: list[str], slope: np.ndarray, bend: np.ndarray) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """A regression tree on Newton steps: the paths to its nodes, and what it adds to each row's log odds."""
    found: list[tuple[Condition, ...]] = []
    step = np.zeros(len(x))

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            found.append(path)
        s, b = slope[rows], bend[rows]
        best: tuple[float, str, float] | None = None
        if len(path) < DEPTH and len(rows) >= 2 * LEAF:
            whole = s.sum() ** 2 / (b.sum() + 1)
            for j, name in enumerate(names):
                v = x[rows, j]
                cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1]))
                at = np.searchsorted(cuts, v)  # the first cut that isn't below
                n, ss, bb = (np.cumsum(np.bincount(at, w, len(cuts) + 1))[:-1] for w in (np.ones(len(v)), s, b))
                gain = ss**2 / (bb + 1) + (s.sum() - ss) ** 2 / (b.sum() - bb + 1) - whole
                gain[(n < LEAF) | (len(v) - n < LEAF)] = -1
                if len(cuts) and gain.max() > (best[0] if best else 1e-6):
                    best = (gain.max(), name, float(cuts[gain.argmax()]))
        if best is None:
            step[rows] = s.sum() / (b.sum() + 1)
            return
        _, name, cut = best
        low = x[rows, names.index(name)] <= cut
        grow(rows[low], (*path, (name, False, cut)))
        grow(rows[~low], (*path, (name, True, cut)))

    grow(np.arange(len(x)), ())
    return found, step


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """The model of labelled rows; equal rows in another order give the same trees up to rounding.

    No rows give even odds; rows of one class give that class's (smoothed) share and no rules.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return RuleModel(bias)
    odds = np.full(len(y), bias)
    paths: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        found, step = _paths(x, names, y - p, p * (1 - p))
        paths |= dict.fromkeys(found)
        odds += STEP * step
        if not found:
            break
    rules = list(paths)
    hold = np.array([_holds(x, names, r) for r in rules], dtype=float).T
    spread = np.maximum(hold.std(axis=0), 0.05)
    z = (hold - hold.mean(axis=0)) / spread
    # Accelerated proximal gradient; the logistic loss bends by at most a quarter of the largest eigenvalue.
    rate = 1 / (0.25 * np.linalg.eigvalsh(z.T @ z / len(y))[-1] + 1e-9)
    w = v = np.zeros(len(rules))
    b, t = bias, 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(b + z @ v)))
        step = v + rate * (z.T @ (y - p)) / len(y)
        now = np.sign(step) * np.maximum(np.abs(step) - rate * LASSO, 0)
        b += (y - p).mean() * 2
        t_now = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = now, now + (t - 1) / t_now * (now - w), t_now
    kept = [(float(w[i] / spread[i]), rules[i]) for i in np.flatnonzero(w)]
    return RuleModel(float(b - (w / spread) @ hold.mean(axis=0)), kept)


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> RuleModel:
    """The model of at most so many labelled documents, the first by a hash of their id.

    Null labels and ids are left out; of an id's several labels the least counts.
    """
    taken = labels.where(F.col(label).isNotNull() & F.col(id_).isNotNull()).groupBy(id_).agg(F.min(label).cast("int").alias("_label"))
    taken = taken.orderBy(F.xxhash64(id_), id_).limit(rows)
    known = docs.select(id_, text).join(F.broadcast(taken), id_)  # rows is the bound of its size
    columns = features()
    got = text_stats(known, text=text).orderBy(F.xxhash64(id_), id_).select("_label", *[c.alias(f"f_{k}") for k, c in columns.items()]).limit(2 * rows).collect()
    data = np.array([tuple(r) for r in got], dtype=float).reshape(-1, 1 + len(columns))
    return fit_rules(data[:, 1:], data[:, 0], list(columns))


def score_quality(docs: DataFrame, model: RuleModel, *, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """The other columns of docs (and the text, if it is kept), score and predicted. Null and empty texts are scored by their zero statistics."""
    rest = [c for c in docs.columns if (keep_text or c != text) and c not in ("score", "predicted")]
    if keep_text:  # it goes to Python and back once, within the row
        named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
        stats = text_stats(named, text=f"c{rest.index(text)}", keep_text=True).withColumn("row_", F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)]))
    else:
        stats = text_stats(docs.select(row_of(rest).alias("row_"), text), text=text)
    columns = features()
    named = stats.select("row_", *[c.alias(f"f_{k}") for k, c in columns.items()])
    out = named.select("row_", model.score({k: F.col(f"f_{k}") for k in columns}).alias("score"))
    return out.select(*[F.col("row_").getField(c).alias(c) for c in rest], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(id_: str = "doc_id") -> Column:
    """Whether a document's label is kept from the fit: its id's crc32 leaves no remainder by five; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit(""))) % 5 == 0


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's score of every whole text of documents."""
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out())
    return score_quality(docs, fit_quality(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
