"""Line dedup by winnowing over the hashes of lines.

A passage is a run of consecutive lines with WORDS words or more. From each line on the shortest
passage is a window; the line of least hash in it is selected, and its hash is the window's fingerprint.
Equal passages hold equal windows, so they select equal lines: the selected positions, about one for
several short lines, are joined on their fingerprints, and those that are alone go no further. Around
the others the match is extended both ways: a position has the hashes of the stretches about it, the
windows it is the least of and these windows up to each line at which a passage that starts with them
can end. A stretch that also stands at an earlier position is deleted. Stretches cover every repeated
passage from its first to its last line, so a line goes just if it lies in a passage that equals an
earlier one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from palimpsest.llm.common import docs_of, materialize, sliced

#: Words from which a run of lines counts as a passage.
WORDS = 50


def prints_of(text: str, words: int = WORDS) -> list[tuple[int, list[tuple[bytes, int, int]]]]:
    """For each selected line its hash, and the stretches about it as (hash of all lines, first line, last line)."""
    import xxhash

    lines = text.encode().split(b"\n")
    upto = np.concatenate([[0], np.cumsum([len(x.split()) for x in lines])])
    if upto[-1] < words:
        return []
    ends = np.searchsorted(upto, upto[:-1] + words)  # the first end that takes in enough words from each line on
    starts = np.searchsorted(upto, upto[1:] - words, side="right") - 1  # the last start that does up to each line
    ends = ends[ends <= len(lines)].tolist()
    digests = [xxhash.xxh3_64_digest(x) for x in lines]
    number = [int.from_bytes(d, "little", signed=True) for d in digests]
    least: list[int] = []  # of each window, the leftmost if hashes are equal
    rising: deque[int] = deque()
    line = 0
    for first, end in enumerate(ends):
        while line < end:
            while rising and number[rising[-1]] > number[line]:
                rising.pop()
            rising.append(line)
            line += 1
        while rising[0] < first:
            rising.popleft()
        least.append(rising[0])
    stretches = {(i, e - 1) for i, e in enumerate(ends)} | {(s, j) for j, s in enumerate(starts.tolist()) if s >= 0}
    flat = b"".join(digests)
    about: dict[int, list[tuple[bytes, int, int]]] = {}
    for i, j in stretches:
        about.setdefault(least[i], []).append((xxhash.xxh3_128_digest(flat[8 * i : 8 * j + 8]), i, j))
    return [(number[p], found) for p, found in about.items()]


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """(id, h, print, stretches) of the selected lines of docs (id, h, text)."""
    stretch = pa.struct([("all", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [prints_of(t, words) if t else [] for t in batch.column("text").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            flat = [p for f in found for p in f]
            each = [s for _, about in flat for s in about]
            cols = list(zip(*each, strict=True)) if each else [(), (), ()]
            parts = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, stretch, strict=True)], fields=list(stretch))
            offsets = pa.array(np.cumsum([0, *(len(about) for _, about in flat)]), pa.int32())
            made = [pa.array([p for p, _ in flat], pa.int64()), pa.ListArray.from_arrays(offsets, parts)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(row) for c in ("id", "h")] + made, ["id", "h", "print", "stretches"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, h bigint, print bigint, stretches array<struct<all:binary,first:int,last:int>>")


def line_dedup(df: DataFrame, *, id_: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """df with its texts cut, and columns n_lines and n_removed (both bigint) of each text's lines.

    Earlier is: of lesser id, null ids last, then of lesser text hash, then of lesser line; a passage
    isn't earlier than one that it overlaps, so the first copy in a run of equal lines stays whole.
    Rows of one id and text are one document: neither is earlier, and they are cut alike. Null texts
    stay null and count no lines; an empty text is one line; a text may become empty. Lines are parted
    by U+000A and compared byte by byte. Other columns stay, ones named n_lines and n_removed are replaced.
    """
    docs = df.select(F.col(id_).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    selected = materialize(_prints(docs, words), "line-prints")
    # What is joined with is written first, so that Spark can split a key that very many rows have.
    common = materialize(selected.groupBy("print").count().where("count > 1").select("print"), "line-prints-common")
    met = materialize(selected.join(common, "print").select("id", "h", "print", F.inline("stretches")), "line-stretches")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "first")
    again = met.groupBy("print", "all").agg(F.min(place).alias("place"), F.max(place).alias("final")).where("place <> final").select("print", "all", "place")
    both = met.join(materialize(again, "line-stretches-again"), ["print", "all"])
    apart = F.struct("place.none", "place.id", "place.h") != F.struct(F.col("id").isNull().alias("none"), "id", "h")
    later = both.where((place > F.col("place")) & (apart | (F.expr("place.first + last - first") < F.col("first"))))
    cut = later.select("id", "h", "first", "last").distinct().groupBy("id", "h").agg(F.collect_list(F.struct("first", "last")).alias("cut"))
    rest = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(id_).alias("id"), F.xxhash64(text).alias("h")).alias("d")
    cuts = rows.join(cut.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.h") == F.col("c.h")), "left").select("row", "cut")
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            row = batch.column("row")
            texts, many, gone = [], [], []
            for t, spans in zip(row.field(text).to_pylist(), batch.column("cut").to_pylist(), strict=True):
                lines = [] if t is None else t.split("\n")
                keep = np.ones(len(lines), dtype=bool)
                for s in spans or ():
                    keep[s["first"] : s["last"] + 1] = False
                texts.append(t if keep.all() else "\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k))
                many.append(len(lines))
                gone.append(int((~keep).sum()))
            columns = [pa.array(texts, row.type.field(at).type) if i == at else row.field(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(many, pa.int64()), pa.array(gone, pa.int64())], [f"c{i}" for i in range(len(rest) + 2)])

    kinds = [f.dataType for f in rows.schema["row"].dataType] + [LongType(), LongType()]
    done = cuts.mapInArrow(run, StructType([StructField(f"c{i}", k) for i, k in enumerate(kinds)]))
    return done.toDF(*rest, "n_lines", "n_removed")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without later repeated passages: how many lines went, and a digest of what stays."""
    done = line_dedup(docs_of(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
