"""Threshold-scaled document fingerprints, in DataFrame functions alone.

A fingerprint keeps every hash of a word shingle that lies below a fixed fraction of the hash
range. So its size follows the document's, two fingerprints can be compared however unequal their
documents are, and the fingerprint of a union follows from the fingerprints. A text of which fewer than
LEAST hashes lie there keeps its LEAST least ones instead (all that it has, if they are fewer). So every
fingerprint holds all hashes of its text up to a bound of its own, which short texts have high, and two
are compared up to the lower bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import docs_of, fresh, partitions

#: Words of a shingle, the fraction of all hashes that is kept, as one part in so many, and the hashes kept at least.
WORDS, PART, LEAST = 5, 8, 16


def _limit(part: int) -> int:
    """The greatest hash that lies in the kept fraction."""
    return -(2**63) + 2**64 // part - 1


def with_sketch(df: DataFrame, text: str, out: str, *, words: int = WORDS, part: int = PART) -> DataFrame:
    """df with a column out: the ascending distinct hashes kept of a text, array<bigint>.

    A shingle is so many consecutive words (parted by U+0020 and U+0009 to U+000D), or all words of a
    shorter text. Just texts without words (null and empty ones among them) have an empty sketch.
    Other columns stay, one named out is replaced.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != out]
    h, s, k = (fresh(df.columns, name) for name in ("_hashes", "_shingles", "_kept"))
    hashed = df.select(*rest, F.expr(f"transform(filter(split(coalesce(`{text}`, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), w -> xxhash64(w))").alias(h))
    # The hashes are used more than once, so Catalyst doesn't move their making into the lambda.
    shingled = hashed.select(
        *rest,
        F.expr(f"CASE WHEN size({h}) >= {words} THEN transform(sequence(1, size({h}) - {words - 1}), i -> xxhash64(slice({h}, i, {words}))) WHEN size({h}) > 0 THEN array(xxhash64({h})) ELSE array() END").alias(s),
    )
    kept = shingled.select(*rest, s, F.expr(f"sort_array(array_distinct(filter({s}, x -> x <= {_limit(part)}L)))").alias(k))
    return kept.select(*rest, F.when(F.size(k) >= LEAST, F.col(k)).otherwise(F.slice(F.sort_array(F.array_distinct(s)), 1, LEAST)).alias(out))


def merged(a: Column, b: Column, *, part: int = PART) -> Column:
    """The sketch of the shingles of two documents together, exactly; null if either is."""
    both = F.sort_array(F.array_union(a, b))
    kept = F.filter(both, lambda x: x <= _limit(part))
    return F.when(F.size(kept) >= LEAST, kept).otherwise(F.slice(both, 1, LEAST))


def _bound(sketch: Column, part: int) -> Column:
    """Up to where a sketch holds all hashes of its text."""
    return F.when(F.size(sketch) < LEAST, F.lit(2**63 - 1)).otherwise(F.greatest(F.lit(_limit(part)), F.element_at(sketch, -1)))


def likeness(a: Column, b: Column, *, part: int = PART) -> Column:
    """The estimated share of the lesser document's shingles that the other has; 1 for equal sketches, 0 if just one is empty.

    Null, which is unknown, if the two differ and either has no hash up to the lower bound: a text of few
    shingles beside a long one.
    """
    bound = F.least(_bound(a, part), _bound(b, part))
    x, y = F.filter(a, lambda v: v <= bound), F.filter(b, lambda v: v <= bound)
    known = F.when(a == b, 1.0).when(F.least(F.size(a), F.size(b)) == 0, 0.0)
    return known.otherwise(F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))))


def as_text(sketch: Column) -> Column:
    """A sketch as a string of 16 hexadecimal digits a hash; '' if it is empty, null for null."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_next(df: DataFrame, payload: list[str], *, id_: str = "doc_id", out: str = "next") -> DataFrame:
    """df with a struct column of the payload of the next row in descending order of a numeric id; after the last comes the first.

    Equal ids are ordered by the hash of the payload, null ids come last. One shuffle: rows are dealt
    into ranges of ids that quantiles bound, and the first row of each range is also sent to the end
    of the range before. Only the bounds come to the driver. A single row is next to itself.
    """
    n = max(1, partitions(df.sparkSession, 2))
    at = [i / n for i in range(n + 1)]
    got = df.select(F.percentile_approx(id_, at, 10 * n).alias("q")).first()["q"] or []
    tops = sorted(set(got), reverse=True)  # each is the highest id of a range
    own = [c for c in df.columns if c != out]
    known, where, place, more = (fresh(own, name) for name in ("_tops", "_at", "_place", "_more"))
    rest = [F.col(f"`{c}`") for c in own]
    if tops:
        # How many tops are not below the id, by bisection; the last of them is the range's.
        middle = "cast((s.lo + s.hi) div 2 as int)"
        many = F.expr(
            f"aggregate(sequence(1, {math.ceil(math.log2(len(tops) + 1)) + 1}), named_struct('lo', 0, 'hi', {len(tops)}), "
            f"(s, i) -> if(s.lo >= s.hi, s, if({known}[{middle}] >= `{id_}`, named_struct('lo', {middle} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle}))), s -> s.lo)"
        )
        last = len(tops) - 1
        placed = df.select(*rest, F.array(*map(F.lit, tops)).alias(known)).withColumn(where, F.when(F.col(id_).isNull(), last).otherwise(many - 1))
        here = F.struct(F.col(where).alias("at"), F.lit(False).alias("copy"))
        there = F.struct(F.when(F.col(where) == 0, last).otherwise(F.col(where) - 1).alias("at"), F.lit(True).alias("copy"))
        is_top = F.coalesce(F.element_at(known, F.col(where) + 1) == F.col(id_), F.lit(False))
        dealt = placed.select(*rest, F.explode(F.when(is_top, F.array(here, there)).otherwise(F.array(here))).alias(place))
    else:
        dealt = df.select(*rest, F.struct(F.lit(0).alias("at"), F.lit(False).alias("copy")).alias(place))
    order = Window.partitionBy(f"{place}.at").orderBy(f"{place}.copy", F.col(id_).desc_nulls_last(), F.xxhash64(*payload))
    # Each column by itself: a struct of them would be shuffled beside them.
    ahead = {c: fresh(own, f"_next_{c}") for c in payload}
    led = dealt.select("*", F.lead(F.lit(True)).over(order).alias(more), *[F.lead(c).over(order).alias(a) for c, a in ahead.items()]).where(~F.col(f"{place}.copy"))
    led = led.select(*rest, F.when(F.col(more), F.struct(*[F.col(a).alias(c) for c, a in ahead.items()])).alias(out))
    if tops:
        return led
    # Without an id every row is in one range, ordered by its hash; the last is followed by the first.
    first = df.select(F.min_by(F.struct(*payload), F.xxhash64(*payload)).alias(more))
    return led.join(F.broadcast(first)).select(*rest, F.coalesce(out, more).alias(out))


def edited(text: Column, following: Column) -> Column:
    """A text whose last half, rounded down, is replaced by as much as there is of the start of the following; null if either is."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(text.substr(F.lit(1), F.length(text) - half), following.substr(F.lit(1), half))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of documents and of its edited text, and how like they are to it."""
    docs = docs_of(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(with_sketch(docs, "text", "sketch"), ["text", "sketch"])
    changed = led.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited(F.col("text"), F.col("next.text")).alias("edited"))
    both = with_sketch(changed, "edited", "edited_sketch")
    near = {"edited": likeness(F.col("sketch"), F.col("edited_sketch")), "next": likeness(F.col("sketch"), F.col("next_sketch"))}
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        # No hash in common is known of unknown ones; the flags tell them from known zeros.
        *[F.coalesce(x, F.lit(0.0)).alias(f"near_{k}") for k, x in near.items()],
        *[x.isNotNull().alias(f"known_{k}") for k, x in near.items()],
    )
