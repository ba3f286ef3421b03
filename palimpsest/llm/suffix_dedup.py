"""Repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of SPAN bytes that covers it also starts anywhere else. Three exact steps
leave little for the transforms. Each SPAN-byte string has an owner: the least hash among the
first WINDOW positions, which depends on the string alone, so equal strings have equal owners. The
strings of one owner share a middle, the SPAN - WINDOW + 1 bytes from the owner on: an owner whose
middle is found nowhere else repeats nothing. And owners whose whole surroundings are equal repeat
everything. What is left are owners with equal middles and unequal surroundings. Each becomes a
short string, its middle one symbol. Shards of those strings are suffix-sorted apart; their
Burrows-Wheeler transforms are then merged by refining the interleave once for every symbol of
depth, which also yields where common prefixes end: after WINDOW rounds, suffixes in one interval
begin with the same SPAN bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import docs_of, materialize, with_row

SPAN, WINDOW, GRAM = 400, 64, 8
#: Strings of a shard; of a task's merge, about; and with one middle up to which they are merged: see windows_of_crowds().
SHARD, MERGE, CROWD = 512, 12_000, 4_096
#: Bytes whose owners are looked for together.
CHUNK = 1 << 21


def owners(raws: list[bytes], span: int = SPAN, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, owner, its first string, its last string) of all owners in some texts, positions in bytes of the text."""
    size = np.array([len(r) for r in raws], dtype=np.int64)
    base = np.cumsum(size) - size
    flat = b"".join(raws) + bytes(GRAM + window)
    n = int(size.sum())
    gram = np.empty(n + window, dtype=np.uint64)
    for j in range(GRAM):
        part = np.frombuffer(flat, dtype="<u8", offset=j, count=(len(flat) - j) // GRAM)
        gram[j::GRAM] = part[: len(gram[j::GRAM])]
    gram *= np.uint64(0x9E3779B97F4A7C15)
    gram ^= gram >> np.uint64(32)
    gram *= np.uint64(0xD6E8FEB86659FD93)
    # The position in the low bits: the least number is then the leftmost least hash.
    bits = np.uint64(max(1, int(len(gram)).bit_length()))
    least = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    owner = (least[:n] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(raws)), size)
    fits = np.flatnonzero(np.arange(n) + span <= np.repeat(base + size, size))  # where a string starts
    if not len(fits):
        return (np.zeros(0, np.int64),) * 4
    own = owner[fits]
    edge = np.flatnonzero((own[1:] != own[:-1]) | (np.diff(fits) != 1))
    first, last = fits[np.concatenate([[0], edge + 1])], fits[np.concatenate([edge, [len(fits) - 1]])]
    t = text[first]
    return t, owner[first] - base[t], first - base[t], last - base[t]


def _scan(docs: DataFrame, span: int, window: int) -> DataFrame:
    """(id, h, at, before, after, middle, around) of every owner: at is its place, before and after how far before it its first and last string start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        mid = span - window + 1
        for batch in batches:
            raws = [b"" if t is None else t.encode() for t in batch.column("text").to_pylist()]
            i = 0
            while i < len(raws):
                j, total = i + 1, len(raws[i])
                while j < len(raws) and total + len(raws[j]) <= CHUNK:
                    total += len(raws[j])
                    j += 1
                part = raws[i:j]
                text, at, first, last = owners(part, span, window)
                rows = list(zip(text.tolist(), at.tolist(), first.tolist(), last.tolist(), strict=True))
                middle = np.array([digest(part[t][a : a + mid]) for t, a, _, _ in rows], dtype=np.uint64).view(np.int64)
                around = np.array([digest(part[t][f : e + span], a - f) for t, a, f, e in rows], dtype=np.uint64).view(np.int64)
                here = pa.array(text + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(here), batch.column("h").take(here), pa.array(at, pa.int32()), pa.array(at - first, pa.int16()), pa.array(at - last, pa.int16()), pa.array(middle), pa.array(around)],
                    ["id", "h", "at", "before", "after", "middle", "around"],
                )
                i = j

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, h bigint, at int, before smallint, after smallint, middle bigint, around bigint")


def _surroundings(docs: DataFrame, asked: DataFrame, span: int, window: int) -> DataFrame:
    """(middle, around, n, crowd, whole, left, right) of asked owners: a long digest of the middle and the bytes that strings take from either side."""
    wanted = asked.groupBy("id", "h").agg(F.collect_list(F.struct("at", "before", "after", "middle", "around", "n", "crowd")).alias("asked")).alias("w")
    both = docs.alias("d").join(wanted, F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.h") == F.col("w.h"))).select("d.text", "w.asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        mid = span - window + 1
        for batch in batches:
            out = []
            for t, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                raw = t.encode()
                for q in asked:
                    a = q["at"]
                    out.append((q["middle"], q["around"], q["n"], q["crowd"], xxhash.xxh3_128_digest(raw[a : a + mid]), raw[a - q["before"] : a], raw[a + mid : a - q["after"] + span]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["middle", "around", "n", "crowd", "whole", "left", "right"])

    return both.mapInArrow(run, "middle bigint, around bigint, n bigint, crowd boolean, whole binary, left binary, right binary")


class Shard:
    """The Burrows-Wheeler transform of some strings of symbols, each ended by 0, and which suffix each of its rows is."""

    def __init__(self, strings: list[np.ndarray], first: int) -> None:
        size = np.array([len(s) + 1 for s in strings])
        start = np.cumsum(size) - size
        symbol = np.zeros(int(size.sum()), dtype=np.int64)
        string = np.repeat(np.arange(len(strings)), size)
        inside = np.ones(len(symbol), dtype=bool)
        inside[start + size - 1] = False
        symbol[inside] = np.concatenate(strings)
        end = np.repeat(start + size, size)
        rank, reach, here = symbol, 1, np.arange(len(symbol))
        order = here
        while reach < 2 * size.max():
            after = np.where(here + reach < end, rank[np.minimum(here + reach, len(symbol) - 1)] + 1, 0)
            key = rank << 32 | after
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty_like(rank)
            rank[order] = new
            if new[-1] == len(symbol) - 1:
                break
            reach *= 2
        self.transform = np.where(order == start[string[order]], 0, symbol[order - 1]).astype(np.uint16)
        self.string, self.offset, self.strings = string[order] + first, order - start[string[order]], len(strings)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, interval) of all suffixes of some shards in the order of their first depth symbols.

    Suffixes are in one interval if those symbols are equal (an end of string is equal to any other).
    The interleave says from which shard each row of the merged transform comes. Sorting it stably by
    the symbols that stand before its rows makes it right for one symbol more, and rows part there that
    differ in that symbol or were parted before; no suffix is compared with another.
    """
    transform = np.concatenate([s.transform for s in shards])
    sizes = [len(s.transform) for s in shards]
    ends = sum(s.strings for s in shards)
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    place = np.arange(len(transform))  # the row of all transforms that stands at each place
    interval = np.zeros(len(transform), dtype=np.int64)
    for _ in range(depth):
        before = transform[place]
        order = np.argsort(before, kind="stable")
        before, was = before[order], interval[order]
        parted = np.empty(len(order), dtype=bool)
        parted[0] = False
        parted[1:] = (before[1:] != before[:-1]) | (was[1:] != was[:-1])
        parted[:ends] = False
        now, new = interleave[order], np.cumsum(parted)
        if np.array_equal(now, interleave) and np.array_equal(new, interval):
            break
        interleave, interval = now, new
        place = np.empty_like(place)
        place[np.argsort(interleave, kind="stable")] = np.arange(len(place))
    string, offset = (np.concatenate([getattr(s, k) for s in shards])[place] for k in ("string", "offset"))
    return string, offset, interval


def repeated_starts(wholes: list[bytes], lefts: list[bytes], rights: list[bytes], window: int = WINDOW) -> np.ndarray:
    """For each owner the strings that some other owner here has too: bit i stands for the one that starts i bytes before it."""
    out = np.zeros(len(wholes), dtype=np.uint64)
    names = {w: i for i, w in enumerate(dict.fromkeys(wholes))}
    if 257 + len(names) > 1 << 16:
        raise ValueError("too many middles for 16-bit symbols")
    strings = [
        np.concatenate([np.frombuffer(a, np.uint8).astype(np.int64) + 1, [257 + names[w]], np.frombuffer(b, np.uint8).astype(np.int64) + 1])
        for w, a, b in zip(wholes, lefts, rights, strict=True)
    ]
    shards = [Shard(strings[i : i + SHARD], i) for i in range(0, len(strings), SHARD)]
    string, offset, interval = merge(shards, window)
    left, right = (np.array([len(x) for x in xs]) for xs in (lefts, rights))
    back = left[string] - offset  # bytes before the owner
    whole = (back >= 0) & (window - 1 - back <= right[string])  # as long as a window: it starts a string that this owner owns
    many = np.bincount(interval[whole], minlength=int(interval[-1]) + 1)
    hit = whole & (many[interval] > 1)
    np.bitwise_or.at(out, string[hit], np.uint64(1) << back[hit].astype(np.uint64))
    return out


def _merged(members: DataFrame, window: int) -> DataFrame:
    """(middle, around, mask) of the owners whose middles are shared by up to CROWD kinds of surroundings."""
    members = members.where(~F.col("crowd"))
    tasks = max(1, -(-members.count() // MERGE))

    def run(table):
        masks = repeated_starts(table["whole"].to_pylist(), table["left"].to_pylist(), table["right"].to_pylist(), window)
        return pa.table([table["middle"], table["around"], table["n"], pa.array(masks.view(np.int64))], names=["middle", "around", "n", "mask"])

    dealt = members.withColumn("task", F.pmod(F.xxhash64("middle"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(run, "middle bigint, around bigint, n bigint, mask bigint")


def windows_of_crowds(members: DataFrame, window: int) -> DataFrame:
    """As _merged, for middles with more kinds of surroundings than one task should hold: their strings are counted by their bytes."""
    members = members.where("crowd")
    starts = members.select("*", F.explode(F.expr(f"sequence({window - 1} - length(right), length(left))")).alias("back"))
    rest = F.expr(f"concat(substring(left, length(left) - back + 1, back), substring(right, 1, {window - 1} - back))")
    starts = starts.select("middle", "around", "n", "whole", "back", rest.alias("rest"))
    found = starts.groupBy("whole", "back", "rest").count().where("count > 1").select("whole", "back", "rest")
    return starts.join(found, ["whole", "back", "rest"]).groupBy("middle", "around", "n").agg(F.bit_or(F.expr("shiftleft(1L, back)")).alias("mask"))


def repeated_spans(df: DataFrame, *, id_: str = "doc_id", text: str = "text", span: int = SPAN, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """docs (id, h, text) and (id, h, found) of the texts with repeated strings: array of (at, before, after, mask)."""
    docs = df.select(F.col(id_).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    scanned = materialize(_scan(docs, span, window), "owners")
    # Written before the join, so that Spark can split a middle that very many owners share.
    shared = materialize(scanned.groupBy("middle").count().where("count > 1").select("middle"), "middles")
    owned = materialize(scanned.join(shared, "middle"), "owners-shared")
    kinds = owned.groupBy("middle", "around").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "at", "before", "after")).alias("one"))
    kinds = materialize(kinds, "owner-kinds")
    several = kinds.groupBy("middle").count().where("count > 1").select("middle", (F.col("count") > CROWD).alias("crowd"))
    asked = kinds.join(several, "middle").select("one.*", "middle", "around", "n", "crowd")
    members = materialize(_surroundings(docs, asked, span, window), "owner-surroundings")
    masks = _merged(members, window).unionByName(windows_of_crowds(members, window)).where("n = 1 AND mask <> 0").select("middle", "around", "mask")
    every = kinds.where("n > 1").select("middle", "around", F.lit(-1).cast("bigint").alias("mask"))
    told = materialize(every.unionByName(masks), "owner-masks")
    found = owned.join(told, ["middle", "around"]).select("id", "h", "at", "before", "after", "mask").distinct()
    return docs, found.groupBy("id", "h").agg(F.collect_list(F.struct("at", "before", "after", "mask")).alias("found"))


def suffix_dedup(df: DataFrame, *, id_: str = "doc_id", text: str = "text", span: int = SPAN, window: int = WINDOW) -> DataFrame:
    """df with kept (the UTF-8 bytes that stay), removed (array of start and end of the maximal runs that go) and n_bytes.

    A byte goes if a string of span bytes over it also starts anywhere else in any row, its own included;
    strings are those of the input and don't cross rows. Null texts count as empty; texts shorter
    than span stay whole; rows of one id and text are cut alike, both occurrences counting. Other columns
    stay, ones named like the new are replaced. window must be at most 64 and less than span.
    """
    if not (0 < window <= 64 and window + GRAM <= span):
        raise ValueError("window must be 64 at most, and a gram less than span")
    _, found = repeated_spans(df, id_=id_, text=text, span=span, window=window)
    rest = [c for c in df.columns if c not in ("kept", "removed", "n_bytes")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(id_).alias("id"), F.xxhash64(text).alias("h")).alias("d")
    both = rows.join(found.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.h") == F.col("f.h")), "left").select("row", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            kept, removed, many = [], [], []
            for t, found in zip(row.field(text).to_pylist(), batch.column("found").to_pylist(), strict=True):
                raw = b"" if t is None else t.encode()
                many.append(len(raw))
                if not found:
                    kept.append(raw)
                    removed.append([])
                    continue
                depth = np.zeros(len(raw) + 1, dtype=np.int32)
                for q in found:
                    if q["mask"] == -1:
                        depth[q["at"] - q["before"]] += 1
                        depth[q["at"] - q["after"] + span] -= 1
                    else:
                        for back in range(q["after"], q["before"] + 1):
                            if q["mask"] >> back & 1:
                                depth[q["at"] - back] += 1
                                depth[q["at"] - back + span] -= 1
                gone = np.cumsum(depth[:-1]) > 0
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                removed.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            runs = pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([row, pa.array(kept, pa.binary()), runs, pa.array(many, pa.int64())], ["row", "kept", "removed", "n_bytes"])

    done = both.mapInArrow(run, with_row(rows, "kept binary, removed array<struct<start:int,end:int>>, n_bytes bigint"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in rest], "kept", "removed", "n_bytes")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the bytes of repeated 400-byte strings."""
    done = suffix_dedup(docs_of(spark, sf_dir).select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
