"""Character n-gram naive Bayes, as tables.

A model is a table of grams with their counts in either class; totals are one row. Scoring joins
the distinct texts' grams with the model and sums, so no model is held by Python.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.plans.storage import written
from palimpsest.sources.observations import NEGATIVE, NEGATIVE_2, POSITIVE, POSITIVE_2

ALPHA, LENGTH_FOR_TRUST, SUPPORT_FOR_TRUST = 0.5, 14.0, 0.35


#: Characters that are cut into grams at a time; a bound of memory, not of results.
PIECE = 2_000_000
LOW, HIGH, DIGITS = 2, 5, 12


def _strings(codes: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    size = 1 + (codes > 0x7F).astype(np.int32) + (codes > 0x7FF) + (codes > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(size.sum(axis=1, dtype=np.int64))]).astype(np.int32)
    data = np.ascontiguousarray(codes, dtype="<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(data))


def _gram_counts(texts: list[str], labels: list[int]) -> Iterator[pa.RecordBatch]:
    """(gram, c0, c1) of some texts, a gram once or a few times; labels are 0, 1 or 2, which is neither.

    Every place is one number: the label and the codes of the next five characters. In their order the grams of
    each length stand together, so they are sorted once.
    """
    if not texts:
        return
    pad = HIGH - 1
    codes = np.frombuffer("".join(f"^{t}$" + "\0" * pad for t in texts).encode("utf-32-le"), dtype="<u4")
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2
    met = np.zeros(sys.maxunicode + 1, dtype=bool)
    met[codes] = True
    letters = np.flatnonzero(met)
    if len(letters) >= 1 << DIGITS:
        if len(texts) > 1:
            for part in (slice(0, len(texts) // 2), slice(len(texts) // 2, None)):
                yield from _gram_counts(texts[part], labels[part])
            return
        said = f"^{texts[0]}$"  # one text with very many different characters
        many = Counter(said[i : i + n] for n in range(LOW, HIGH + 1) for i in range(len(said) - n + 1))
        count = pa.array(many.values(), pa.int64())
        none = pa.array(np.zeros(len(many), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(many.keys(), pa.string()), *[count if labels[0] == k else none for k in (0, 1)]], ["gram", "c0", "c1"])
        return
    coded = np.cumsum(met, dtype=np.uint64)[codes]
    ends = np.cumsum(sizes + pad)
    inside = np.ones(len(coded), dtype=bool)
    for i in range(1, pad + 1):
        inside[ends - i] = False
    coded[~inside] = 0
    coded = np.concatenate([coded, np.zeros(pad, dtype=np.uint64)])
    keys = np.repeat(np.array(labels, dtype=np.uint64) << np.uint64(DIGITS * HIGH), sizes + pad)
    for i in range(HIGH):
        keys |= coded[i : i + len(keys)] << np.uint64(DIGITS * (HIGH - 1 - i))
    keys = np.sort(keys[inside])
    mask = np.uint64((1 << DIGITS) - 1)
    for n in range(LOW, HIGH + 1):
        cut = keys >> np.uint64(DIGITS * (HIGH - n))
        starts = np.concatenate([[0], np.flatnonzero(cut[1:] != cut[:-1]) + 1])
        count, first = np.diff(np.append(starts, len(cut))), cut[starts]
        whole = (first & mask) != 0
        count, first = count[whole], first[whole]
        told = np.stack([letters[((first >> np.uint64(DIGITS * (n - 1 - i))) & mask).astype(np.int64) - 1] for i in range(n)], axis=1)
        label = first >> np.uint64(DIGITS * n)
        yield pa.RecordBatch.from_arrays([_strings(told), *[pa.array(np.where(label == k, count, 0)) for k in (0, 1)]], ["gram", "c0", "c1"])


def fit(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model of examples (text, label 0 or 1): (gram, c0, c1) of the n-grams of two to five characters, and one row of totals (docs0, docs1, total0, total1, vocabulary).

    Texts are cut and counted by pieces in Python, in time in proportion to their characters; counts are summed up by Spark.
    """
    said = examples.select(text.plain(F.col("text")).alias("said"), F.when(F.col("label").isin(0, 1), F.col("label").cast("int")).otherwise(2).alias("label")).where("said <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        labels: list[int] = []
        size = 0
        for batch in batches:
            for t, k in zip(batch.column("said"), batch.column("label").to_pylist(), strict=True):
                texts.append(t.as_py())
                labels.append(k)
                size += len(texts[-1]) + HIGH + 1
                if size >= PIECE:
                    yield from _gram_counts(texts, labels)
                    texts, labels, size = [], [], 0
        yield from _gram_counts(texts, labels)

    counted = said.mapInArrow(run, "gram string, c0 bigint, c1 bigint")
    table = counted.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    sums = table.agg(F.sum("c0").alias("total0"), F.sum("c1").alias("total1"), F.count("*").alias("vocabulary"))
    docs = examples.agg(*[F.count_if(F.col("label") == k).alias(f"docs{k}") for k in (0, 1)])
    return table, docs.join(F.broadcast(sums))


def seeds(spark: SparkSession, corpus: int = 1) -> DataFrame:
    """The package's own examples: the first corpus, or the second in more languages."""
    positive, negative = ((POSITIVE, NEGATIVE), (POSITIVE_2, NEGATIVE_2))[corpus - 1]
    return spark.createDataFrame([(t, 1) for t in positive] + [(t, 0) for t in negative], "text string, label int")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Examples in place of the package's own, from JSON lines of text and label; other labels than 0 and 1 and empty texts are left out."""
    return spark.read.schema("text string, label int").json(path).where("label IN (0, 1) AND trim(text) <> ''")


def key_of(said: Column) -> Column:
    """A text's 128-bit hash, which stands for it in joins."""
    return F.struct(F.xxhash64(said).alias("h1"), F.xxhash64(said, F.lit(1)).alias("h2"))


#: Grams of all models up to which texts are scored where they stand, and the places of the table that this takes.
ROWWISE, PLACES = 100_000, 20_000_000


def _weights(models: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(gram, w_x for each model x), and one row of their priors (prior_x)."""
    weights, priors = None, None
    for x, (table, totals) in models.items():
        base = [F.col(f"total{k}") + ALPHA * F.greatest("vocabulary", F.lit(1)) for k in (0, 1)]
        t = totals.select(*[b.alias(f"base{k}") for k, b in enumerate(base)])
        weight = F.log((F.col("c1") + ALPHA) / F.col("base1")) - F.log((F.col("c0") + ALPHA) / F.col("base0"))
        one = table.join(F.broadcast(t)).select("gram", weight.alias(f"w_{x}"))
        odds = totals.select((F.log(F.col("docs1") + 1.0) - F.log(F.col("docs0") + 1.0)).alias(f"prior_{x}"))
        weights = one if weights is None else weights.join(one, "gram", "full")
        priors = odds if priors is None else priors.join(odds)  # one row each
    return written(weights, "gram-weights"), priors


def _scored(x: str, prior: Column, total: Column, known: Column, every: Column, letters: Column) -> list[Column]:
    """probability_x and support_x from the sums over a text's grams."""
    odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), prior + total))
    support = F.try_divide(known, every)
    trust = F.least(F.lit(1.0), letters / LENGTH_FOR_TRUST) * F.least(F.lit(1.0), support / SUPPORT_FOR_TRUST)
    drawn = 0.5 + (1.0 / (1.0 + F.exp(-odds)) - 0.5) * trust
    return [F.coalesce(F.when(known > 0, drawn), F.lit(0.5)).alias(f"probability_{x}"), F.coalesce(support, F.lit(0.0)).alias(f"support_{x}")]


def _letters(plain: Column) -> Column:
    return F.length(F.regexp_replace(plain, r"[^\p{L}\p{N}]", ""))


def sum_grams(texts: list[str], letters: np.ndarray, child: np.ndarray, weights: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text and model the sum of weights of its known grams, and how many they are.

    letters are the grams' characters, ascending; child is the table of a tree: where a node (0: none, from 1: the first characters)
    leads to by a character (0: none of these).
    """
    sums, many = np.zeros((len(texts), weights.shape[1])), np.zeros((len(texts), weights.shape[1]))
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + (2 + HIGH)
    codes = np.frombuffer("".join(f"^{t}$" + "\0" * HIGH for t in texts).encode("utf-32-le"), dtype="<u4")
    at = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    coded = np.where(letters[at] == codes, at + 1, 0)
    ends = np.cumsum(sizes)
    for i in range(1, HIGH + 1):
        coded[ends - i] = 0
    where = np.flatnonzero(coded)
    node, row = coded[where], np.repeat(np.arange(len(texts)), sizes)
    for n in range(1, HIGH):
        node = child[node, coded[where + n]]
        kept = node > 0
        where, node = where[kept], node[kept]
        for m in range(weights.shape[1]):
            sums[:, m] += np.bincount(row[where], weights=weights[node, m], minlength=len(texts))
            many[:, m] += np.bincount(row[where], weights=known[node, m], minlength=len(texts))
    return sums, many


def row_scorer(models: dict[str, tuple[DataFrame, DataFrame]]) -> Callable[[Column], Column] | None:
    """What makes the struct of probability_x and support_x for each model x of a text's plain form, row by row; see score_models().

    None if the models' grams are too many for a table that every worker holds.
    """
    weights, priors = _weights(models)
    names = list(models)
    rows = weights.select("gram", *[f"w_{x}" for x in names]).where("gram IS NOT NULL AND length(gram) > 1").limit(ROWWISE + 1).collect()
    letters = sorted({ord(c) for r in rows for c in r["gram"]})
    nodes = {g[:n] for r in rows for g in (r["gram"],) for n in range(2, len(g) + 1)}
    first = len(letters) + 1
    if not rows or len(rows) > ROWWISE or (first + len(nodes)) * first > PLACES:
        return None
    number = {chr(c): i + 1 for i, c in enumerate(letters)}
    number |= {g: first + i for i, g in enumerate(sorted(nodes))}
    child = np.zeros((first + len(nodes), first), dtype=np.int32)
    for g in nodes:
        child[number[g[:-1]], number[g[-1]]] = number[g]
    w, known = np.zeros((len(child), len(names))), np.zeros((len(child), len(names)))
    for r in rows:
        for m, x in enumerate(names):
            if r[f"w_{x}"] is not None:
                w[number[r["gram"]], m], known[number[r["gram"]], m] = r[f"w_{x}"], 1
    table = weights.sparkSession.sparkContext.broadcast((np.array(letters, dtype="<u4"), child, w, known))
    fields = [f"{name}_{x}" for x in names for name in ("sum", "known")]

    def over(said: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(said), 512):
            sums, many = sum_grams([t or "" for t in said.slice(at, 512).to_pylist()], *table.value)
            out.append(np.stack([sums, many], axis=2).reshape(len(sums), -1))
        whole = np.concatenate([np.zeros((0, len(fields))), *out])
        return pa.StructArray.from_arrays([pa.array(whole[:, i]) for i in range(len(fields))], fields)

    summed = F.arrow_udf(over, ", ".join(f"{f} double" for f in fields))
    prior = priors.first()

    def score(plain: Column) -> Column:
        size = F.length(plain) + 2
        every = F.when(size > 2, sum((F.greatest(size - (n - 1), F.lit(0)) for n in range(LOW, HIGH + 1)), F.lit(0))).otherwise(0)
        return F.transform(
            F.array(F.struct(summed(plain).alias("g"), every.alias("every"), _letters(plain).alias("letters"))),
            lambda s: F.struct(*[c for x in names for c in _scored(x, F.lit(prior[f"prior_{x}"]), s["g"][f"sum_{x}"], s["g"][f"known_{x}"], s["every"], s["letters"])]),
        )[0]

    return score


def score_models(texts: DataFrame, models: dict[str, tuple[DataFrame, DataFrame]], *, column: str = "text") -> DataFrame:
    """(column, key, and probability_x and support_x for each model x) of the distinct texts: support is the share of known grams.

    Only known grams count. The probability is drawn towards 0.5 for short texts and for those with
    little support; texts without a known gram have 0.5 and 0, as null and empty ones do. Grams are made
    once for all models, whose weights are written as one table; a text takes part by its hash.
    """
    weights, priors = _weights(models)
    said = texts.select(F.coalesce(column, F.lit("")).alias(column)).distinct().withColumn("key", key_of(F.col(column)))
    plain = said.select("key", text.plain(F.col(column)).alias("_said"))
    cut = plain.select("key", "_said", _letters(F.col("_said")).alias("letters")).select("key", "letters", F.explode(F.expr(text.ngrams("_said"))).alias("gram"))
    known = [f(F.col(f"w_{x}")).alias(f"{name}_{x}") for x in models for name, f in (("sum", F.sum), ("known", F.count))]
    sums = cut.join(weights, "gram", "left").groupBy("key", "letters").agg(F.count("*").alias("all"), *known).join(F.broadcast(priors))
    done = sums.select("key", *[c for x in models for c in _scored(x, *[F.col(c) for c in (f"prior_{x}", f"sum_{x}", f"known_{x}", "all", "letters")])])
    default = [F.coalesce(f"{name}_{x}", F.lit(none)).alias(f"{name}_{x}") for x in models for name, none in (("probability", 0.5), ("support", 0.0))]
    return said.join(done, "key", "left").select(column, "key", *default)


def score(texts: DataFrame, model: tuple[DataFrame, DataFrame], *, column: str = "text") -> DataFrame:
    """(column, probability, support) of the distinct texts under one model; see score_models()."""
    return score_models(texts, {"a": model}, column=column).select(column, F.col("probability_a").alias("probability"), F.col("support_a").alias("support"))


def prototype_margin(vectors: DataFrame, positive: DataFrame, negative: DataFrame, *, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score): how much nearer a vector is, by cosine, to a positive prototype than to a negative one, between 0 and 1.

    positive and negative are one column p of prototypes, few by their nature; they are collected into one
    array each, which every vector is compared with.
    """
    unit = lambda v: f"transform({v}, x -> x / sqrt(aggregate({v}, 0D, (a, y) -> a + y * y)))"
    dots = lambda name: F.expr(f"array_max(transform({name}, p -> aggregate(zip_with(p, v, (a, b) -> a * b), 0D, (a, y) -> a + y)))")
    whole = lambda df, name: df.select(F.expr(unit("p")).alias("p")).agg(F.collect_list("p").alias(name))
    both = whole(positive, "plus").join(whole(negative, "minus"))
    cast = vectors.select(id_, F.col(vector).cast("array<double>").alias("v0")).select(id_, F.expr(unit("v0")).alias("v"))
    margin = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 2 * (dots("plus") - dots("minus"))))
    return cast.join(F.broadcast(both)).select(id_, (0.5 + 0.5 * margin).alias("score"))
