"""Quality rules by weak supervision.

Each rule votes for a text (1), against it (-1) or abstains (0). Expectation-maximisation over the
histogram of vote patterns, which covers all texts and has at most 3 ** rules rows whatever the
size of the corpus, estimates the share of good texts and how each rule votes on good and on bad
ones. The posterior probability that a text is good is then a Spark expression over its votes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import docs_of, materialize
from palimpsest.llm.stats import text_stats

#: Rounds at most; and the votes of each kind that a rule is given before any are counted, in either class.
ROUNDS, SMOOTHING = 200, 0.5


def _against(bad: Column) -> Column:
    """A rule that a text can fail; not to fail it is no evidence, so it abstains."""
    return F.when(bad, -1).otherwise(0)


def _for(good: Column) -> Column:
    return F.when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes, over the columns of text_stats(). Ratios are compared as products, so no text divides by zero."""
    c = F.col
    letters = c("n_upper") + c("n_lower")
    even = (c("n_symbols") * 50 <= c("n_words")) & (c("n_upper") * 4 <= letters) & (c("n_excl") * 25 <= c("n_words"))
    return {
        "length": F.when(c("n_words") < 10, -1).when(c("n_words") >= 50, 1).otherwise(0),
        "symbols": _against(c("n_symbols") * 10 > c("n_words")),
        "marked_words": _against(c("n_symbol_words") * 5 > c("n_words")),
        "repetition": _against(c("n_repeat_words") * 5 > c("n_words")),
        "same_lines": _against(c("n_dup_lines") * 10 > c("n_lines") * 3),
        "capitals": _against(c("n_upper") * 2 > letters),
        "exclaims": _against(c("n_excl") * 5 > c("n_words")),
        "word_length": _against((c("word_chars") < c("n_words") * 2) | (c("word_chars") > c("n_words") * 14)),
        "prose": _for((c("n_ends") > 0) & (c("n_ends") * 2 <= c("n_words")) & even),
        "varied": _for((c("n_words") > 0) & (c("n_unique_words") * 10 >= c("n_words") * 3)),
    }


@dataclass(frozen=True)
class LabelModel:
    """prior: the share of good texts; evidence: what a rule's votes -1, 0 and 1 add to the log odds; accuracy: how often a vote cast is right."""

    prior: float
    evidence: dict[str, tuple[float, float, float]]
    accuracy: dict[str, float]

    def posterior(self, votes: dict[str, Column]) -> Column:
        """The probability that a text with these votes is good."""
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for k, (against, none, favour) in self.evidence.items():
            odds = odds + F.when(votes[k] < 0, against).when(votes[k] > 0, favour).otherwise(none)
        return 1.0 / (1.0 + F.exp(-odds))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, names: list[str]) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns with their counts; no texts give even odds.

    It starts from the belief that a text is bad if any rule votes against it, which also fixes which
    class is the good one. Sums run over sorted patterns, so equal histograms give equal models.
    """
    if not len(patterns):
        return LabelModel(0.5, dict.fromkeys(names, (0.0, 0.0, 0.0)), dict.fromkeys(names, 0.5))
    order = np.lexsort(patterns.T)
    votes, weight = patterns[order], counts[order].astype(float)
    cast = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    good = np.where((votes < 0).any(axis=1), 0.1, 0.9)
    for _ in range(ROUNDS):
        prior = (weight @ good + 1) / (weight.sum() + 2)
        shares = []
        for of in (good, 1 - good):
            many = np.einsum("p,prv->rv", weight * of, cast) + SMOOTHING
            shares.append(many / many.sum(axis=1, keepdims=True))
        evidence = np.log(shares[0] / shares[1])
        now = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + np.einsum("prv,rv->p", cast, evidence))))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    right = weight * good @ (votes > 0) + weight * (1 - good) @ (votes < 0)
    accuracy = (right + SMOOTHING) / (weight @ (votes != 0) + 2 * SMOOTHING)
    return LabelModel(float(prior), {k: tuple(map(float, e)) for k, e in zip(names, evidence, strict=True)}, dict(zip(names, map(float, accuracy), strict=True)))


def quality_by_rules(df: DataFrame, *, text: str = "text", keep_at: float = 0.5) -> tuple[DataFrame, LabelModel]:
    """df without its text but with STATS, base_failed, quality (the posterior) and kept; and the model.

    The model is fitted on the votes of every row. A null or empty text has no words: base_failed,
    so it isn't kept. An empty table gives an empty table. Equal texts get equal verdicts.
    """
    stats = materialize(text_stats(df, text=text), "quality-stats")
    votes = rules()
    names = list(votes)
    rows = stats.select(*[v.cast("int").alias(k) for k, v in votes.items()]).groupBy(*names).count().collect()  # 3 ** len(names) at most
    model = fit_label_model(np.array([r[:-1] for r in rows]).reshape(-1, len(names)), np.array([r[-1] for r in rows]), names)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    out = stats.withColumn("base_failed", failed).withColumn("quality", model.posterior(votes))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at)), model


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' verdict on every whole text of documents."""
    done, _ = quality_by_rules(docs_of(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
