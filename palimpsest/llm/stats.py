"""Statistics of whole texts, one Arrow pass; the inputs of the quality rules and the quality classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import row_of, sliced, with_row

#: Words in a window of which a second occurrence counts as repetition.
WINDOW = 5

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_ENDS = b".!?"
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: The columns that text_stats() adds, all bigint; every count is of the whole text.
STATS = (
    "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_unique_words",
    "n_upper", "n_lower", "n_digits", "n_excl", "n_ends", "n_commas", "n_symbol_words", "longest_word",
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which is found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        mixed = mixed * _ODD + (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    likely = np.zeros(n, dtype=bool)
    likely[order[1:][same]] = likely[order[:-1][same]] = True
    at = np.flatnonzero(likely).tolist()
    grams = [tuple(words[i : i + window]) for i in at]  # equal hashes are no proof
    seen = Counter(grams)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i, g in zip(at, grams, strict=True):
        if seen[g] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def _left(raw: bytes, drop: bytes) -> int:
    return len(raw.translate(None, drop))


def stats_of(text: str | None) -> tuple[int, ...]:
    """STATS of one text; a null text counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # parts bytes at just the six characters that part words
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(raw)
    solid = _left(raw, _SPACE)
    marks = raw.translate(None, _SPACE + _UPPER + _LOWER + _DIGITS)
    return (
        len(text), len(words), len(text) - (n - solid), n - _left(raw, _SYMBOLS), len(lines), len(lines) - len(set(lines)), repeated_words(words), len(set(words)),
        n - _left(raw, _UPPER), n - _left(raw, _LOWER), n - _left(raw, _DIGITS), marks.count(b"!"), len(marks) - _left(marks, _ENDS), marks.count(b","),
        sum(1 for w in words if w[-1] in _SYMBOLS), max(map(len, words), default=0),
    )


def text_stats(df: DataFrame, *, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The other columns of df, and STATS in place of its text column (or beside it).

    Null and empty texts have zero counts; an empty table gives an empty table; equal rows stay.
    A column named like one of STATS is replaced.
    """
    keep = [c for c in df.columns if (keep_text or c != text) and c not in STATS]
    work = df.select(row_of(keep).alias("row"), *([] if keep_text else [F.col(f"`{text}`").alias("text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("row").field(text) if keep_text else batch.column("text")
            rows = np.array([stats_of(t) for t in texts.to_pylist()], dtype=np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c) for c in rows.T)], ["row", *STATS])

    return work.mapInArrow(run, with_row(work, ", ".join(f"{c} bigint" for c in STATS))).select(*[F.col("row").getField(c).alias(c) for c in keep], *STATS)
