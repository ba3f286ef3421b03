"""Token shards in training order.

Texts become sequences of a fixed number of token ids. A keyed Feistel network over the least
power of two that holds all sequences, walked along its cycles until it lands among them, gives
every sequence a slot: a permutation without a table. Slots are range-partitioned and each range
writes whole shards, in which the record of a slot starts at a fixed stride, so that a reader can
go on from any slot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import CHUNK, LibraryCodec, _chunks, _vocabulary, codec, read_ranks
from palimpsest.llm.common import docs_of, materialize, partitions, shared_dir, sliced, union_all

#: Tokens of a sequence, sequences of a shard, rounds of the network.
LENGTH, SHARD, ROUNDS = 256, 16_384, 6
#: Ranges of shards that are shuffled one after the other, so that only a part of all tokens lies in shuffle files at a time.
WAVES = 2
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Id that ends a document and fills up its last sequence.
END = 50_256


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed hash of 64-bit numbers (the finaliser of splitmix64)."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def round_keys(seed: int) -> list[int]:
    """A key for each round of the network."""
    return [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), seed % 2**64)]


def permute(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The slots of indices below n: a permutation of range(n) that the seed chooses.

    The network's halves may differ by a bit; its domain is less than twice n, so a walk takes two steps on average.
    """
    out = np.asarray(index, dtype=np.uint64).copy()
    if n < 2:
        return out.astype(np.int64)
    bits = max(2, (n - 1).bit_length())
    low = bits // 2
    widths = (bits - low, low)  # of the left and the right half
    keys = round_keys(seed)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(low), out[todo] & np.uint64((1 << low) - 1)
        wl, wr = widths
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & np.uint64((1 << wl) - 1))
            wl, wr = wr, wl
        out[todo] = (left << np.uint64(wr)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(df: DataFrame, path: str, *, id_: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(id, part, n_tokens, tokens) of each text's ids and the end mark, cut into parts of length ids; tokens are 16-bit, filled up with end.

    Null and empty texts give one sequence of the end mark. Rows of df with one id stay apart; an empty table
    gives an empty table. A vocabulary whose ids don't fit 16 bits, or have the end mark among them, is refused.
    """
    vocab, pattern = _vocabulary(df.sparkSession, path, None)
    known = set(read_ranks(vocab.value).values())
    if max(known | {end}) > 0xFFFF or min(known | {end}) < 0:
        raise ValueError("ids of over 16 bits")
    if end in known:
        raise ValueError(f"the end mark {end} is a token of the vocabulary")
    work = df.select(F.col(id_).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab.value, pattern, LibraryCodec)
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            for a, b in _chunks([len(t) for t in texts], CHUNK):
                ids, sizes = c.encode(texts[a:b])
                parts = sizes // length + 1
                first = np.cumsum(parts) - parts
                flat = np.full(int(parts.sum()) * length, end, dtype="<u2")
                flat[np.arange(len(ids)) + np.repeat(first * length - (np.cumsum(sizes) - sizes), sizes)] = ids
                row = np.repeat(np.arange(a, b), parts)
                part = np.arange(len(row)) - np.repeat(first, parts)
                n = np.minimum(length, np.repeat(sizes + 1, parts) - part * length)
                tokens = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((np.arange(len(row) + 1) * 2 * length).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(part, pa.int32()), pa.array(n, pa.int32()), tokens], ["id", "part", "n_tokens", "tokens"])

    return work.mapInArrow(run, f"id {work.schema['id'].dataType.simpleString()}, part int, n_tokens int, tokens binary")


def with_slots(stored: DataFrame, seed: int = 0, shard: int = SHARD, waves: int = WAVES) -> DataFrame:
    """stored, a written table, with each row's slot, dense from 0, the number of its shard, and the range and wave that the shard is written in.

    Rows are numbered as they lie in the files (file, then row of the file); only a count for each file
    comes to the driver. So a task that runs again numbers its rows as before. An empty table has no slots.
    """
    spark = stored.sparkSession
    counts = sorted((r[0], r[1]) for r in stored.groupBy(F.col("_metadata.file_name").alias("f")).count().collect())
    sizes = np.array([c for _, c in counts], dtype=np.int64)
    n = int(sizes.sum())
    offsets = spark.createDataFrame([(f, int(o)) for (f, _), o in zip(counts, np.cumsum(sizes) - sizes, strict=True)], "file string, offset bigint")
    placed = stored.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    placed = placed.join(F.broadcast(offsets), "file").withColumn("index", F.col("offset") + F.col("row_index")).drop("file", "offset", "row_index")

    @F.pandas_udf("bigint")
    def slot(index):
        import pandas as pd

        return pd.Series(permute(index.to_numpy(), n, seed))

    ranges = partitions(spark)  # in each wave
    placed = placed.withColumn("slot", slot("index")).drop("index").withColumn("shard", F.floor(F.col("slot") / shard).cast("int"))
    place = F.floor(F.col("shard").cast("bigint") * (ranges * waves) / (-(-n // shard) or 1)).cast("int")
    return placed.withColumn("wave", F.floor(place / ranges).cast("int")).withColumn("range", place % ranges)


def _store(folder: str):
    """The file system of a folder, and the folder's path there."""
    from pyarrow import fs

    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_shards(placed: DataFrame, folder: str, *, shard: int = SHARD, waves: int = WAVES) -> DataFrame:
    """Write tokens by slot into folder/shard-NNNNNNNN.bin; the index (slot, shard, byte_offset, id, part, n_tokens, sha256) of every record.

    Shards are written in waves of consecutive ranges; a wave's shuffle files go when its shards and its
    part of the index are written. A shard is written under another name and renamed when whole, so a
    task that ends early or runs twice leaves whole shards only. folder is any address that pyarrow's
    file systems know.
    """
    spark = placed.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return union_all([materialize(_wave(placed.where(F.col("wave") == w), folder, shard), f"shard-index-{w}") for w in range(waves)])
    finally:
        spark.conf.set(_CLEANUP, before)


def _wave(placed: DataFrame, folder: str, shard: int) -> DataFrame:
    # Slots are dense, so ranges of equal size are known beforehand; a range partitioner would read everything once more to find them.
    dealt = placed.repartitionById(partitions(placed.sparkSession), "range").sortWithinPartitions("slot")
    tokens = dealt.select("shard", "slot", "id", "part", "n_tokens", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        now, sink, name = None, None, ""

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(name, f"{top}/shard-{now:08d}.bin")

        for batch in sliced(batches):
            shards, records = batch.column("shard").to_pylist(), batch.column("tokens").to_pylist()
            for s, r in zip(shards, records, strict=True):
                if s != now:
                    close()
                    now, name = s, f"{top}/.{uuid.uuid4().hex}"
                    sink = store.open_output_stream(name)
                sink.write(r)
            at = pa.array([(x % shard) * len(r) for x, r in zip(batch.column("slot").to_pylist(), records, strict=True)], pa.int64())
            digest = pa.array([hashlib.sha256(r).hexdigest() for r in records])
            yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("shard"), at, batch.column("id"), batch.column("part"), batch.column("n_tokens"), digest], ["slot", "shard", "byte_offset", "id", "part", "n_tokens", "sha256"])
        close()

    kind = placed.schema["id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"slot bigint, shard int, byte_offset bigint, id {kind}, part int, n_tokens int, sha256 string")


def read_shards(folder: str, slot: int, n: int, *, length: int = LENGTH, shard: int = SHARD) -> Iterator[np.ndarray]:
    """The token ids of the slots from slot to n - 1, read in sequence; a reader that stopped goes on from its next slot."""
    store, top = _store(folder)
    while slot < n:
        with store.open_input_file(f"{top}/shard-{slot // shard:08d}.bin") as f:
            f.seek(slot % shard * 2 * length)
            while slot < n:
                yield np.frombuffer(f.read(2 * length), dtype="<u2")
                slot += 1
                if slot % shard == 0:
                    break


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as token shards in training order: where each sequence lies, and a digest of its record."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    stored = materialize(sequences(docs_of(spark, sf_dir).select("doc_id", "text"), path), "sequences")
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    return write_shards(with_slots(stored), folder).withColumnRenamed("id", "doc_id")
