"""Packing into length buckets that waste the least padding.

The histogram of sequence lengths covers the whole corpus and has at most max_tokens rows. Dynamic
programming over it chooses the bucket boundaries with the least padding in all; batches within a
token budget are then formed inside each bucket, in an order that a hash gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.bpe import CHUNK, LibraryCodec, _chunks, _vocabulary, codec
from palimpsest.llm.common import docs_of, materialize, partitions, row_of, sliced, with_row

#: Tokens of a sequence at most, buckets at most, tokens of a batch (padding included) at most.
MAX_TOKENS, BUCKETS, BUDGET = 2048, 16, 65_536


def token_counts(df: DataFrame, path: str, *, text: str = "text", out: str = "n_tokens", pattern: str | None = None) -> DataFrame:
    """df with the number of a text's tokens, bigint, under the vocabulary at path in place of the text; none for null."""
    vocab, pattern = _vocabulary(df.sparkSession, path, pattern)
    rest = [c for c in df.columns if c not in (text, out)]
    work = df.select(row_of(rest).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab.value, pattern, LibraryCodec)
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            many = [c.encode(texts[a:b])[1] for a, b in _chunks([len(t) for t in texts], CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate([np.zeros(0, np.int64), *many]), pa.int64())], ["row", "n"])

    done = work.mapInArrow(run, with_row(work, "n bigint"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in rest], F.col("n").alias(out))


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """At most so many upper bounds for the given lengths with the least padding, and that padding.

    Exact: cost[k][j] is the least padding of the j shortest lengths in k buckets. No lengths, no bounds.
    """
    if not len(lengths):
        return [], 0
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    n, k = len(lengths), min(buckets, len(lengths))
    many, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(lengths * counts)])
    cost = np.full(n + 1, np.iinfo(np.int64).max // 4)
    cost[0] = 0
    back = np.zeros((k + 1, n + 1), dtype=np.int64)
    for b in range(1, k + 1):
        now = cost.copy()  # fewer buckets are allowed
        back[b] = -1
        for j in range(1, n + 1):
            # The last bucket holds lengths i to j - 1.
            whole = cost[:j] + lengths[j - 1] * (many[j] - many[:j]) - (tokens[j] - tokens[:j])
            i = int(whole.argmin())
            if whole[i] < now[j]:
                now[j], back[b, j] = whole[i], i
        cost = now
    bounds, j, b = [], n, k
    while j:
        if back[b, j] >= 0:
            bounds.append(int(lengths[j - 1]))
            j = int(back[b, j])
        b -= 1
    return bounds[::-1], int(cost[n])


def pack(df: DataFrame, *, id_: str = "doc_id", n_tokens: str = "n_tokens", max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Sequences (id, piece, start, length, bucket, batch, place) of documents with so many tokens.

    A document takes its tokens and one mark of its end, so none is empty; a longer one than max_tokens
    gives several pieces. bucket is the length that its sequences are padded to; batch numbers a
    bucket's batches of budget // bucket sequences (one at least), place a batch's sequences from 0.
    The order in a bucket is that of a hash of id and piece. A null count is none; null ids and repeated
    rows are documents of their own; an empty table has no sequences. Only the id of df is kept. df is
    read twice, so it should be a written table.
    """
    n = F.greatest(F.coalesce(F.col(n_tokens), F.lit(0)), F.lit(0)) + 1
    last = F.ceil(n / max_tokens).cast("int") - 1
    pieces = df.select(F.col(id_).alias("id"), n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * max_tokens
    pieces = pieces.select("id", "piece", start.alias("start"), F.least(F.lit(max_tokens), F.col("n") - start).cast("int").alias("length"))
    rows = pieces.groupBy("length").count().collect()  # max_tokens rows at most
    bounds, _ = best_boundaries(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64), buckets)
    if not bounds:
        return pieces.select("id", "piece", "start", "length", F.lit(0).alias("bucket"), F.lit(0).cast("bigint").alias("batch"), F.lit(0).alias("place"))
    bucket = F.array_min(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("length")))
    slices = partitions(df.sparkSession)
    # Slices of the hash's range, in its order: each is numbered alone, from what the slices before it hold.
    h = F.xxhash64("id", "piece")
    placed = pieces.select("*", bucket.alias("bucket"), h.alias("h")).withColumn("slice", F.expr(f"cast(shiftright((shiftright(h, 32) + 2147483648) * {slices}, 32) as int)"))
    held = placed.groupBy("bucket", "slice").count()  # buckets * slices rows at most
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.select("bucket", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("h", "id", "piece", "length")) - 1
    numbered = placed.withColumn("rank", rank).join(F.broadcast(offset), ["bucket", "slice"])
    a_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    at = F.col("offset") + F.col("rank")
    return numbered.select("id", "piece", "start", "length", "bucket", F.floor(at / a_batch).alias("batch"), (at % a_batch).cast("int").alias("place"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of all documents."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counted = materialize(token_counts(docs_of(spark, sf_dir).select("doc_id", "text"), path), "token-counts")
    return pack(counted).withColumnRenamed("id", "doc_id")
