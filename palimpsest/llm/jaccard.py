"""Links between texts whose sets of word shingles are alike, exactly, by prefix filtering.

Put every set into one order of all shingles. If two sets have a Jaccard similarity of t or more, the
first shingle that both have is among the first n - ceil(t * n) + 1 of the larger set and among the first
n - ceil(2 * t / (1 + t) * n) + 1 of the lesser, n being the set's own size. So sets are joined on
these prefixes, pairs whose sizes or places rule the similarity out are dropped, and the whole
sets of the rest are compared. Any order gives the same pairs; shingles that many texts have come last,
so that few texts meet under one. Shingles that only one set has there meet nobody and go first.

Each set also has a sketch: whether it has an odd number of shingles in each of 1,024 cells. Two
sketches differ in no more bits than the sets differ in shingles, so pairs whose sketches are too far
apart for the similarity are dropped without reading the sets; no pair that is alike is.

Sets that are crowded under one shingle are first compared with one of them, the pivot. Those that this
leaves in different components are paired where sketches, sizes and places allow it, if the crowd is
of CROWDS sets at most. Larger crowds aren't paired out. They are compared with a better chosen
pivot, and what is alike is linked to it; such sets need no links among each other. One minus the
similarity is a metric, so whatever lies nearer to the pivot than all sets that aren't alike do, by more
than 1 - t, can't be linked to any of those and is done with. Of the others, two sets either have a
shingle in common that the pivot hasn't, and are joined on the first of those that the sizes ask for, or
they share no more than either shares with the pivot, which the sizes must leave room for. Pairs that
the links found so far have put in one component are left out: they need no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, sliced, union_all
from palimpsest.llm.graph import components

#: Texts looked at for common shingles, the texts among them that make one common, and how many come to the driver at most.
SAMPLE, COMMON, MOST_COMMON = 20_000, 4, 200_000
#: Lesser sets under one shingle from which the sets there count as a crowd, and those up to which a crowd is paired.
CROWD, CROWDS = 32, 1_024
#: Bits of a sketch.
CELLS = 1_024


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The 64-bit hashes of one text's shingles in their order, repeats among them; none if it has no word."""
    import xxhash

    parts = (text or "").encode().lower().split()  # of bytes, lower() and split() know ASCII only
    if not parts:
        return np.empty(0, dtype="<u8")
    flat, size = b" ".join(parts), len(parts)
    if size <= words:
        hashes = [xxhash.xxh64_intdigest(flat, 42)]
    else:
        end = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=size) + 1)
        first = np.concatenate([[0], end[: size - words]])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], 42) for a, b in zip(first.tolist(), (end[words - 1 :] - 1).tolist(), strict=True)]
    return np.array(hashes, dtype="<u8")


def simhash_of(h: np.ndarray) -> int:
    """The 64-bit SimHash of hashes, as a signed number: a bit is set if it is in over half of them; zero if there are none."""
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def sketch_of(s: np.ndarray) -> np.ndarray:
    """Whether a set of hashes has an odd number in each cell, as CELLS bits in signed numbers."""
    cells = np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view("<i8")


def _set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, "<u8"), *arrays]).view("<i8")))


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """The hashes of shingles that many texts of a sample have, ascending. They set the joins' cost, not their result."""
    part = docs.select("text").sample(min(1.0, SAMPLE / max(1, docs.count())), seed=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [_set(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, "<u8"), *sets]).view("<i8"))], ["k"])

    many = part.mapInArrow(run, "k bigint").groupBy("k").count().where(F.col("count") >= COMMON)
    found = many.orderBy(F.col("count").desc(), "k").limit(MOST_COMMON).select("k").toPandas()["k"].to_numpy(dtype="<i8")
    return np.sort(found.view("<u8"))


def prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """docs (id, h, text) as (id, h, fp, n, sim, odd, head): the hash, size, SimHash and sketch of each text's set, and the start of it that is joined on."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        last = common.value
        for batch in sliced(batches):
            prints, sizes, heads, sims, odd = [], [], [], [], []
            for t in batch.column("text").to_pylist():
                s = _set(t, words)
                prints.append(xxhash.xxh64_intdigest(s.tobytes(), 42))
                sizes.append(len(s))
                sims.append(simhash_of(s))
                odd.append(sketch_of(s).view("<u8"))
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                heads.append(s[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1])
            made = [pa.array(np.array(prints, dtype="<u8").view("<i8")), pa.array(sizes, pa.int32()), pa.array(sims, pa.int64()), _lists(odd), _lists(heads)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), *made], ["id", "h", "fp", "n", "sim", "odd", "head"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, h bigint, fp bigint, n int, sim bigint, odd array<bigint>, head array<bigint>")


def _within(similarity: float) -> Column:
    """Whether the sketches of x and y, with sizes, leave room for the similarity: alike sets differ in so many shingles at most."""
    bits = " + ".join(f"bit_count(x.odd[{i}] ^ y.odd[{i}])" for i in range(CELLS // 64))
    return F.expr(bits) <= (1 - similarity) / (1 + similarity) * F.expr("x.n + y.n") + 1e-9


def _with_similarity(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """pairs (u, v, and what else) with shared, the shingles that both sets have, and alike, their Jaccard similarity."""
    both = pairs.join(whole.select(F.col("fp").alias("u"), F.col("s").alias("a")), "u").join(whole.select(F.col("fp").alias("v"), F.col("s").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    counted = both.select(*pairs.columns, shared.alias("shared"), (F.size("a") + F.size("b")).alias("_both"))
    return counted.select(*pairs.columns, "shared", F.coalesce(F.try_divide(F.col("shared"), F.col("_both") - F.col("shared")), F.lit(1.0)).alias("alike"))


def _sets(texts: DataFrame, sets: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(fp, s): the whole sets of wanted (fp), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = _lists([_set(t, words) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("fp"), made], ["fp", "s"])

    # By id and text, so that the many copies of one text don't meet in one task.
    i = F.xxhash64("id").alias("i")
    one = sets.select("fp", "h", i).join(wanted.distinct(), "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("h", "i")).alias("one")).select("fp", "one.*")
    found = texts.select("h", i, "text").join(one, ["h", "i"]).dropDuplicates(["h", "i"])
    whole = found.select("fp", "text").mapInArrow(run, "fp bigint, s array<bigint>")
    return materialize(whole, "near-sets")


def similar(texts: DataFrame, sets: DataFrame, prints: DataFrame, first: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (u, v) of the fp of sets, as written by prefixes() from texts (id, h, text), that are alike.

    prints has each fp once, with n and odd. first are pairs (u, v) to compare besides those found here; links
    among them save comparisons in crowds. Every two sets that are alike are in one component of the links.
    Equal sets have one fp and are no pair. A crowd under one shingle costs a comparison of each set with the
    pivot and of sketches in pairs, or, if it is larger than CROWDS, of sets that have rare shingles in common
    which the pivot hasn't.
    """
    share = similarity / (1 + similarity)
    several = sets.select("fp", F.explode("head").alias("k")).groupBy("k").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi")
    several = materialize(several.select("k"), "near-several")
    heads = sets.select("fp", "n", F.posexplode("head").alias("at", "k")).join(several, "k").distinct()
    # Whether the place lies in the prefix that a set has as the lesser one of two.
    heads = materialize(heads.withColumn("lesser", F.col("at") <= F.col("n") - F.ceil(2 * share * F.col("n") - 1e-9)), "near-heads")
    # With few lesser ones under a shingle, pairs are so many times the sets there at most.
    hot = heads.groupBy("k").agg(F.count_if("lesser").alias("crowd")).where(F.col("crowd") > CROWD)
    hot = materialize(hot.select("k", (F.col("crowd") > CROWDS).alias("large")), "near-crowds")

    def paired(rows: DataFrame, more: Column | None = None) -> DataFrame:
        x, y = rows.alias("x"), rows.alias("y")
        near = (F.col("x.k") == F.col("y.k")) & F.col("x.lesser") & (F.struct("x.n", "x.fp") < F.struct("y.n", "y.fp"))
        near &= F.col("x.n") >= similarity * F.col("y.n") - 1e-9
        # At the first shingle that both have, what follows it in either set bounds what they share.
        near &= F.least(F.expr("x.n - x.at"), F.expr("y.n - y.at")) >= share * F.expr("x.n + y.n") - 1e-9
        return x.join(y, near if more is None else near & more).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")).distinct()

    def sketched(pairs: DataFrame) -> DataFrame:
        """pairs (u, v) whose sketches leave room for the similarity."""
        x = pairs.join(prints.select(F.col("fp").alias("u"), F.struct("n", "odd").alias("x")), "u")
        return x.join(prints.select(F.col("fp").alias("v"), F.struct("n", "odd").alias("y")), "v").where(_within(similarity)).select("u", "v")

    def alike(pairs: DataFrame, whole: DataFrame) -> DataFrame:
        return _with_similarity(pairs, whole).where(F.col("alike") >= similarity - 1e-9).select("u", "v")

    def compared(pairs: DataFrame) -> DataFrame:
        return alike(pairs, _sets(texts, sets, pairs.select(F.explode(F.array("u", "v")).alias("fp")), words))

    crowded = materialize(heads.join(hot, "k"), "near-crowded")
    # What lies under many of these shingles is like many sets, and a good pivot at first.
    central = crowded.groupBy("fp").agg(F.count("*").alias("central"))
    pivots = materialize(crowded.join(central, "fp").groupBy("k").agg(F.max_by("fp", F.struct("central", F.xxhash64("fp"))).alias("v")), "near-pivots")
    stars = crowded.select("k", F.col("fp").alias("u")).join(pivots, "k").where("u <> v").select("u", "v")
    pairs = union_all([first.select("u", "v"), paired(heads.join(hot, "k", "left_anti")), stars]).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    known = materialize(compared(materialize(sketched(pairs.distinct()), "near-candidates")), "near-links")
    if hot.isEmpty():
        return known
    large = materialize(crowded.where("large").drop("large"), "near-large")
    if not large.isEmpty():
        known = materialize(union_all([known, _beyond_pivots(texts, sets, large, pivots, known, paired, alike, words, similarity)]), "near-links")
    # Only sets that these links leave in different components are compared any further.
    roots = components(known).withColumnRenamed("node", "fp")
    rest = crowded.where("NOT large").join(roots, "fp", "left").withColumn("part", F.coalesce("root", "fp")).join(prints.select("fp", "odd"), "fp")
    rest = materialize(rest.select("k", "fp", "n", "at", "lesser", "part", "odd"), "near-members")
    beside = paired(rest, (F.col("x.part") != F.col("y.part")) & _within(similarity))
    return union_all([known, compared(materialize(beside, "near-beside"))])


def _beyond_pivots(texts: DataFrame, sets: DataFrame, crowded: DataFrame, pivots: DataFrame, known: DataFrame, paired: Callable, alike: Callable, words: int, similarity: float) -> DataFrame:
    """Links (u, v) of crowds too large to be paired; with known ones they link what is alike under their shingles."""
    share = similarity / (1 + similarity)
    whole = _sets(texts, sets, crowded.select("fp").unionByName(pivots.select(F.col("v").alias("fp"))), words)

    def beyond(pairs: DataFrame) -> DataFrame:
        """pairs (u, v) with each shingle e that u has beyond v's."""
        return pairs.join(whole.select(F.col("fp").alias("u"), "s"), "u").join(whole.select(F.col("fp").alias("v"), F.col("s").alias("has")), "v").select("u", "v", F.explode(F.array_except("s", "has")).alias("e"))

    # A better one has most of what many sets of the crowd have beyond the first, and least of what few have.
    members = crowded.select("k", F.col("fp").alias("u")).join(pivots, "k")
    added = materialize(beyond(members.select("u", "v").distinct()), "near-added")
    many = added.groupBy("v", "e").agg((F.count("*") > CROWD).alias("many"))
    odd = added.join(many, ["v", "e"]).groupBy("u", "v").agg(F.count_if("many").alias("common"), F.count_if(~F.col("many")).alias("rare"))
    rank = F.struct(-F.coalesce("rare", F.lit(0)), F.coalesce("common", F.lit(0)), F.xxhash64("u"))
    pivots = members.join(odd, ["u", "v"], "left").groupBy("k").agg(F.max_by("u", rank).alias("v"))
    members = materialize(crowded.withColumnRenamed("fp", "u").join(materialize(pivots, "near-pivots"), "k"), "near-pivoted")
    compared = materialize(_with_similarity(members.select("u", "v").distinct(), whole), "near-compared")
    inner = F.col("alike") >= similarity - 1e-9
    members = members.join(compared, ["u", "v"])
    known = materialize(known.unionByName(compared.where(inner & (F.col("u") != F.col("v"))).select("u", "v")), "near-links")
    # The greatest similarity to the pivot of those that aren't alike to it; null if there are none.
    outer = members.groupBy("k").agg(F.max(F.when(~inner, F.col("alike"))).alias("next"))
    stays = (F.col("u") != F.col("v")) & (~inner | (F.col("alike") - (1 - similarity) <= F.col("next") + 1e-9))
    rest = members.join(materialize(outer, "near-outer"), "k").where(stays).withColumnRenamed("u", "fp")
    # Only sets that these links leave in different components are compared any further.
    roots = components(known).withColumnRenamed("node", "fp")
    rest = rest.join(roots, "fp", "left").withColumn("part", F.coalesce("root", "fp")).drop("next", "alike", "root")
    rest = materialize(rest, "near-members")
    apart = F.col("x.part") != F.col("y.part")
    room = (1 + similarity) * F.least("x.shared", "y.shared") >= similarity * (F.col("x.n") + F.col("y.n")) - 1e-9
    some = rest.select("v", "fp", "n", "part", "shared").distinct()
    added = materialize(beyond(some.select(F.col("fp").alias("u"), "v")).withColumnRenamed("u", "fp").join(some, ["v", "fp"]), "near-added")
    # So many of its added shingles must a set have in common with another of that pivot, which has at least the least size there.
    least = rest.groupBy("v").agg(F.min("n").alias("least"))
    needs = F.greatest(F.lit(1), F.ceil(share * (F.col("n") + F.greatest(similarity * F.col("n"), F.col("least"))) - 1e-9) - F.col("shared")).cast("int")
    several = materialize(added.groupBy("v", "e").count().where("count > 1"), "near-several")
    few = added.join(several, ["v", "e"]).groupBy("v", "fp", "n", "part", "shared").agg(F.sort_array(F.collect_list(F.struct("count", "e"))).alias("es")).join(least, "v").withColumn("needs", needs)
    few = few.where(F.size("es") >= F.col("needs")).select("v", "fp", "n", "part", F.explode(F.expr("slice(es, 1, size(es) - needs + 1)")).alias("e"))
    added = materialize(few.select("v", "fp", "n", "part", "e.e"), "near-added-first")
    x, y = added.alias("x"), added.alias("y")
    fits = (F.col("x.v") == F.col("y.v")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.fp") < F.col("y.fp")) & apart
    fits &= F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-9
    beside = x.join(y, fits).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")).unionByName(paired(rest, apart & room))
    beside = materialize(beside.distinct(), "near-beside")
    return union_all([known, alike(beside, whole)])
