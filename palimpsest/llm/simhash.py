"""SimHash near-duplicates with the pigeonring filter.

A 64-bit fingerprint is a ring of 16 segments. If two fingerprints differ in at most d bits, then
some segment starts a chain whose first n segments differ in at most n * d / 16 bits in all, for
every n. So a pair is looked for from each of the 16 starts: the first segments of the chain must
be equal and the next may hold one difference, which makes a key of many bits to join on; the
longer chains are checked after the join, and the whole Hamming distance last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import jaccard
from palimpsest.llm.common import cleaned, docs_of, materialize, row_of, sliced, union_all, with_row
from palimpsest.llm.graph import components

SEGMENTS, BITS = 16, 4
#: Fingerprints under one key up to which they are compared in pairs; see links() for the others.
BUCKET = 64


def fingerprint_of(text: str | None, words: int) -> int:
    """The fingerprint of one text, as a signed number; zero if it has no word."""
    return jaccard.simhash_of(jaccard.shingle_hashes(text, words))


def fingerprints(df: DataFrame, *, text: str = "text", words: int = 4, out: str = "fp") -> DataFrame:
    """df without its text but with a column of 64-bit fingerprints, bigint.

    A-Z is lower-cased; a shingle is so many words joined by a space, or all words of a shorter text;
    a bit is set if it is in over half the shingles' hashes, repeats counted. Null and empty texts and
    texts without words have fingerprint 0. Other columns stay, one named like out is replaced.
    """
    rest = [c for c in df.columns if c not in (text, out)]
    work = df.select(row_of(rest).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = pa.array([fingerprint_of(t, words) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), made], ["row", "fp"])

    done = work.mapInArrow(run, with_row(work, "fp bigint"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in rest], F.col("fp").alias(out))


def _chain(distance: int) -> tuple[int, int, list[tuple[int, int]]]:
    """How many first segments are equal, how many more may hold one difference, and (segments, budget) of longer chains."""
    budget = [n * distance // SEGMENTS for n in range(SEGMENTS + 1)]
    key = min(13, max(n for n in range(SEGMENTS + 1) if budget[n] <= 1))  # the start and 13 segments fit a bigint
    equal = min(key, max(n for n in range(SEGMENTS + 1) if budget[n] == 0))
    return equal, key, [(n, budget[n]) for n in range(key + 1, SEGMENTS) if budget[n] != budget[n + 1]]


def _bits(n: int) -> int:
    """n low bits as a signed 64-bit number."""
    return (1 << n) - 1 if n < 64 else -1


def links(prints: DataFrame, distance: int = 4, bucket: int = BUCKET * 16) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints fp that differ in at most so many bits; a pair may come up more than once.

    A key under which more than bucket fingerprints lie isn't paired out. What lies under such a key is
    linked through the points at half the distance instead: two fingerprints differ in at most
    2 * r bits just if some point is within r bits of both; all around one point are hung on the least
    of them, which leaves components as they are.
    """
    if not 1 <= distance <= SEGMENTS // 2:
        raise ValueError(f"distance must lie between 1 and {SEGMENTS // 2}")
    equal, key, later = _chain(distance)
    low, first = key * BITS, equal * BITS
    turned = f"(shiftrightunsigned(fp, {BITS} * i) | shiftleft(fp, 64 - {BITS} * i))"
    base = f"(shiftleft(cast(i as bigint), {low}) | ({turned} & {_bits(low)}L))"
    starts = f"sequence(0, {SEGMENTS - 1})"
    exact = prints.select("fp", F.expr(f"explode(transform({starts}, i -> {base}))").alias("k"))
    flipped = F.lit(None).cast("bigint") if first == low else F.expr(
        f"explode(flatten(transform({starts}, i -> transform(filter(sequence({first}, {low - 1}), b -> {base} & shiftleft(1L, b) <> 0), b -> {base} & ~shiftleft(1L, b)))))"
    )
    cleared = prints.select("fp", flipped.alias("k")).where("k is not null")
    probes = exact.select("fp", "k", F.lit(True).alias("same")).unionByName(cleared.select("fp", "k", F.lit(False).alias("same")))

    hot = materialize(exact.groupBy("k").count().where(F.col("count") > bucket).select("k"), "simhash-hot")
    dense = None
    if not hot.isEmpty():
        dense = probes.join(hot, "k", "left_semi").select("fp").distinct()
        exact = exact.join(hot, "k", "left_anti")
    x, y = probes.alias("x"), exact.alias("y")
    differ = F.expr("x.fp ^ y.fp")
    # The difference, turned to start at the chain's first segment.
    ring = F.expr(f"(shiftrightunsigned(x.fp ^ y.fp, {BITS} * cast(shiftright(x.k, {low}) as int)) | shiftleft(x.fp ^ y.fp, 64 - {BITS} * cast(shiftright(x.k, {low}) as int)))")
    near: Column = (F.col("x.k") == F.col("y.k")) & (~F.col("x.same") | (F.col("x.fp") < F.col("y.fp")))
    for n, most in later:
        near &= F.bit_count(ring.bitwiseAND(F.lit(_bits(n * BITS)))) <= most
    near &= F.bit_count(differ) <= distance
    out = x.join(y, near).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v"))
    return out if dense is None else out.unionByName(_through_points(dense, distance))


def _through_points(dense: DataFrame, distance: int) -> DataFrame:
    """Links of fingerprints around a common point, as stars. For an odd distance one side reaches a bit farther."""
    dense = materialize(dense, "simhash-dense")

    def around(r: int) -> DataFrame:
        masks = "array(0L)"
        for _ in range(r):  # masks of up to r bits
            masks = f"array_distinct(flatten(transform({masks}, m -> transform(sequence(0, 63), b -> m | shiftleft(1L, b)))))"
        return dense.select("fp", F.expr(f"explode(transform(array_union(array(0L), {masks}), m -> fp ^ m))").alias("z"))

    near = around(distance // 2)
    if distance % 2 == 0:
        least = near.groupBy("z").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("z", "v")
        return near.join(least, "z").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    far = around(distance // 2 + 1)
    least = near.groupBy("z").agg(F.min("fp").alias("v"))
    return far.join(least, "z").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def linked(prints: DataFrame, *, id_: str = "doc_id", fp: str = "fp", distance: int = 4, pairs: DataFrame | None = None) -> DataFrame:
    """prints with component (the least fingerprint that can be reached over links) and component_id (the least id there).

    Links are pairs (u, v) of fp if given, else fingerprints at the distance or less. prints is read several times, so it should be a written table. Null ids don't count for the least id;
    a component of null ids only has none. Equal rows stay; an empty table gives an empty table.
    """
    nodes = materialize(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(id_).alias("least_id")), "simhash-nodes")
    found = components(links(nodes.select("fp"), distance) if pairs is None else pairs)
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("component"))
    rooted = materialize(rooted, "simhash-rooted")
    least = rooted.groupBy("component").agg(F.min("least_id").alias("component_id"))
    told = materialize(rooted.join(least, "component").select(F.col("fp").alias(fp), "component", "component_id"), "simhash-components")
    return prints.join(told, fp)


def candidates(prints: DataFrame, distance: int) -> DataFrame:
    """Pairs (u, v) of the fp of prints whose SimHash sim is equal, as stars, or differs in at most so many bits, by one fp of each sim."""
    one = materialize(prints.groupBy("sim").agg(F.min("fp").alias("one")), "near-simhashes")
    same = prints.join(one, "sim").where("fp <> one").select(F.col("fp").alias("u"), F.col("one").alias("v"))
    found = links(one.select(F.col("sim").alias("fp")), distance).distinct()
    found = found.join(one.select(F.col("sim").alias("u"), F.col("one").alias("a")), "u").join(one.select(F.col("sim").alias("v"), F.col("one").alias("b")), "v")
    return materialize(union_all([same, found.select(F.col("a").alias("u"), F.col("b").alias("v"))]), "near-by-simhash")


def near_dedup(df: DataFrame, *, id_: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """The rows of df of which no earlier row is a near copy: of each component the one of least id.

    Rows are linked if their sets of shingles have a Jaccard similarity of so much or more. Pairs whose SimHash
    differs in at most distance bits are compared first; as SimHash can't reach that far, prefixes give
    the pairs that it lacks, see jaccard.py. Of several rows with that id the one whose text's hash
    is least stays; a component of null ids keeps the row of least hash. Texts without words are
    copies of each other.
    """
    docs = df.select(F.col(id_).alias("id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    with cleaned(df.sparkSession):
        sets = materialize(jaccard.prefixes(docs, words, similarity), "near-prefixes")
        prints = materialize(sets.select("fp", "n", "sim", "odd").dropDuplicates(["fp"]), "near-prints")
        pairs = jaccard.similar(docs, sets, prints, candidates(prints, distance), words, similarity)
        known = linked(sets.select("id", "h", "fp"), id_="id", pairs=pairs).where(F.col("id").eqNullSafe(F.col("component_id")))
        least = known.groupBy("component").agg(F.min(F.struct("id", "h")).alias("first")).select("first.id", "first.h").distinct()
        least = materialize(least, "near-kept")
    # Dealt by hashes of id and text, so that the rows are shuffled once; null ids have one hash too.
    i = F.xxhash64("id").alias("i")
    rows = df.select(row_of(df.columns).alias("row"), F.col(id_).alias("id"), F.xxhash64(text).alias("h")).select("row", "id", "h", i).alias("d")
    same = (F.col("d.i") == F.col("k.i")) & (F.col("d.h") == F.col("k.h")) & F.col("d.id").eqNullSafe(F.col("k.id"))
    return rows.join(least.select("id", "h", i).alias("k"), same, "left_semi").dropDuplicates(["i", "h", "id"]).select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of documents and the components of near copies."""
    prints = materialize(fingerprints(docs_of(spark, sf_dir).select("doc_id", "text")), "simhash-docs")
    return linked(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
