"""Secret scans: three fixed patterns, and strings that a tokenizer can hardly compress.

Random strings give a byte-level BPE few characters a token; words and identifiers give it many.
Digests, UUIDs, numbers and identifiers whose parts are words to the tokenizer are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import docs_of, sliced, with_row

#: Characters a token below which a string counts as random, and the least length of a candidate.
CHARS_PER_TOKEN, LEAST = 2.2, 20

#: The base patterns, in the order in which ties are listed: (kind, pattern, group that is measured, its least length).
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
KINDS = [k for k, *_ in BASE] + ["random"]

# A run of hexadecimal letters too short to count can't hide one that counts, so it needn't be matched.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_HINT = re.compile(r"[pPsStTaA](?:[aA][sS][sS][wW]|[eE][cC][rR][eE]|[oO][kK][eE][nN]|[pP][iI]_?[kK][eE][yY])")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_SIZES = frozenset((32, 40, 48, 56, 64, 96, 128))
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
# Parts of identifiers: letters up to a change of case, a digit or a separator.
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: The least letters of a word, and the characters a token from which a part counts as one.
WORD_LETTERS, WORD_CHARS_PER_TOKEN = 3, 3

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """What the base patterns find, each kind on its own: leftmost, not overlapping, short matches dropped."""
    found: list[Span] = []
    if _ASSIGN_HINT.search(text):
        kind, pattern, group, least = BASE[0]
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    kind, pattern, group, least = BASE[1]
    if "AKIA" in text:
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    found += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def benign(s: str) -> bool:
    """Digests, UUIDs and numbers aren't taken for random strings."""
    bare = s.strip("=_-+/")
    if not any(c.isalpha() for c in bare):
        return True
    return bool(len(bare) in _DIGEST_SIZES and _DIGEST.fullmatch(bare) or _UUID.fullmatch(bare))


def identifier(s: str, encoder) -> bool:
    """Whether the parts of s are words to the tokenizer, short ones aside, and make up most of it."""
    bare = s.strip("=_-+/")
    words = [p for p in _PARTS.findall(bare) if len(p) >= WORD_LETTERS]
    if sum(map(len, words)) * 10 < len(bare) * 6:
        return False
    return all(len(p) >= WORD_CHARS_PER_TOKEN * len(encoder.encode_ordinary(" " + p.lower())) for p in words)


def random_spans(text: str, encoder, most: float = CHARS_PER_TOKEN) -> list[Span]:
    """Long strings with fewer characters a token than most."""
    out = []
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        if not benign(s) and len(s) < most * len(encoder.encode_ordinary(s)) and not identifier(s, encoder):
            out.append(("random", m.start(), m.end()))
    return out


_encoders: dict[bytes, object] = {}


def encoder_of(content: bytes):
    """This worker's tiktoken encoder of the ranks in a .tiktoken file."""
    if content not in _encoders:
        import public_tokenizers
        import tiktoken

        from palimpsest.llm.bpe import read_ranks

        _encoders.clear()
        _encoders[content] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(content), special_tokens={})
    return _encoders[content]


def scan_secrets(df: DataFrame, path: str, *, text: str = "text", chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """df with a column spans: array of (kind, start, end, base) in code points, end exclusive, by start.

    A null or empty text has no spans; texts of any length are searched whole; other columns stay, one
    named spans is replaced; an empty table gives an empty table.
    """
    with open(path, "rb") as f:
        vocab = df.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in df.columns if c != "spans"]
    work = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocab.value)
        for batch in sliced(batches):
            row = batch.column("row")
            out = []
            for t in row.field(text).to_pylist():
                base = base_spans(t) if t else []
                more = random_spans(t, encoder, chars_per_token) if t else []
                out.append([{"kind": k, "start": a, "end": b, "base": k != "random"} for k, a, b in ordered(base + more)])
            yield pa.RecordBatch.from_arrays([row, pa.array(out, pa.list_(span))], ["row", "spans"])

    done = work.mapInArrow(run, with_row(work, "spans array<struct<kind:string,start:int,end:int,base:boolean>>"))
    return done.select("row.*", "spans")


def redact(df: DataFrame, *, text: str = "text", spans: str = "spans", mask: str = "[secret]") -> DataFrame:
    """df without spans, each run of overlapping or touching spans of its text replaced by mask. Nulls stay null."""
    at = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    merged = F.aggregate(
        at,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(out, F.array(s))),
    )
    whole = F.col(text)
    cut = F.aggregate(
        merged,
        F.struct(F.lit("").alias("s"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["s"], whole.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("s"), s["end"].alias("at")),
        lambda acc: F.concat(acc["s"], whole.substr(acc["at"] + 1, F.length(whole))),
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(whole)).drop(spans)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    import public_tokenizers

    found = scan_secrets(docs_of(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[many(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(told(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
