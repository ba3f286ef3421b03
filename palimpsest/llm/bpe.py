"""Byte-level BPE with DuckDB recursive queries in each partition.

A text is cut into words by the vocabulary's pattern. Words that are new to the Python worker
become token-position rows; a recursive query joins neighbouring tokens with the merge table
and contracts each word's leftmost pair of least rank until no pair is in the table. Decoding
joins ids with the vocabulary and aggregates their bytes in order of position.

A long word is contracted in overlapping blocks, which are laid together at a token that both have.
That is exact: tokens are what a word contracts to just if every two neighbours among them, contracted
on their own, stay as they are. For the first merge across an edge between two of them would also be
the first across it in these two alone, as nothing from outside has reached them until then. Parts of
what a block contracts to keep that property, and so does what is laid together at a common token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import docs_of, row_of, with_row

#: Words that a worker remembers; then it starts afresh. Bounds memory, not results.
REMEMBERED = 300_000
#: Code points that are tokenised together, and words that one recursive query contracts.
CHUNK, AT_ONCE = 400_000, 8_000
#: Code points of a text up to which the library cuts it into words.
WHOLE = 100_000
#: Rows that one recursive query may make, by the squares of its words' lengths. Bounds memory.
STEPS = 1_000_000
#: Words of more bytes are contracted in blocks of so many, which start every half block.
LONG = 64

_SHORT_SQL = """
WITH RECURSIVE s(it, w, p, t, q, u, k) AS (
  SELECT 0, i.w, i.p, i.t, i.q, i.u, m.k FROM init i LEFT JOIN merges m ON m.pair = (i.t << 32) | i.u
  UNION ALL
  SELECT n.it + 1, n.w, n.p, n.t, n.q, n.u, m.k
  FROM (
    SELECT s.it, s.w, s.q,
      CASE WHEN s.p = b.right_p THEN b.left_p ELSE s.p END AS p,
      CASE WHEN s.p = b.right_p THEN b.merged ELSE s.t END AS t,
      CASE WHEN s.q = b.left_p THEN b.merged ELSE s.u END AS u
    FROM s
    JOIN (
      SELECT w, min((k << 32) | p) & 4294967295 AS left_p, min((k << 32) | p) >> 32 AS merged, arg_min(q, (k << 32) | p) AS right_p
      FROM s WHERE k IS NOT NULL GROUP BY w
    ) b ON s.w = b.w
    WHERE s.p <> b.left_p
  ) n
  LEFT JOIN merges m ON m.pair = (n.t << 32) | n.u
)
SELECT s.w, list(s.t ORDER BY s.p) AS ids
FROM s JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) f ON s.w = f.w AND s.it = f.it
GROUP BY s.w
"""

# A merge is calm if no pair with its result has a lower rank: then all its pairs in a word can be
# contracted in one step, every second one of a run of equal tokens, as one after the other would do.
_LONG_SQL = """
WITH b AS (
  SELECT w, min((k << 32) | p) & 4294967295 AS first_p, min(k) AS merged, arg_min(calm, (k << 32) | p) AS calm
  FROM s WHERE k IS NOT NULL GROUP BY w
), same AS (
  SELECT s.w, s.p, s.q, b.merged, b.calm, b.first_p,
    coalesce(lag(s.q) OVER (PARTITION BY s.w ORDER BY s.p) = s.p, false) AS joined
  FROM s JOIN b ON s.w = b.w AND s.k = b.merged
), runs AS (
  SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY p) AS run FROM same
), hit AS (
  SELECT w, p AS left_p, q AS right_p, merged
  FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY p) AS n FROM runs)
  WHERE CASE WHEN calm THEN n % 2 = 1 ELSE p = first_p END
), n AS (
  SELECT s.w, s.q,
    CASE WHEN r.w IS NOT NULL THEN r.left_p ELSE s.p END AS p,
    CASE WHEN r.w IS NOT NULL THEN r.merged ELSE s.t END AS t
  FROM s
  LEFT JOIN hit l ON s.w = l.w AND s.p = l.left_p
  LEFT JOIN hit r ON s.w = r.w AND s.p = r.right_p
  WHERE l.w IS NULL
), o AS (
  SELECT w, p, q, t, lead(t, 1, -1::BIGINT) OVER (PARTITION BY w ORDER BY p) AS u FROM n
)
SELECT o.w, o.p, o.t, o.q, o.u, m.k, m.calm FROM o LEFT JOIN merges m ON m.pair = (o.t << 32) | o.u
"""

_DECODE_SQL = """
SELECT d.d, unhex(array_to_string(list(v.hx ORDER BY d.p), '')) AS bytes
FROM rows_ d JOIN vocab v ON v.id = d.id GROUP BY d.d
"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every way to make a token from two others: pair (left id, right id), k (the rank of the result) and calm."""
    made = [
        (a, b, k)
        for token, k in ranks.items()
        for i in range(1, len(token))
        if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None
    ]
    left, right, rank = np.array(made, dtype=np.int64).reshape(-1, 3).T
    least = np.full(max(ranks.values()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, left, rank)
    np.minimum.at(least, right, rank)
    return pa.table({"pair": (left << 32) | right, "k": rank, "calm": least[rank] > rank})


class Codec:
    """A vocabulary in a Python worker: its DuckDB tables, character classes and the words encoded so far."""

    def __init__(self, content: bytes, pattern: str) -> None:
        import tiktoken

        self.ranks = read_ranks(content)
        self.widths = np.zeros(max(self.ranks.values()) + 1, dtype=np.int64)
        self.widths[list(self.ranks.values())] = list(map(len, self.ranks))
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        # The classes of characters come from the library's own regular expressions.
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        one = {bytes([i]): i for i in range(256)}
        self.kind = np.zeros(0x110000, dtype=np.uint8)  # 0: none of these
        for n, what in enumerate((r"\s", r"\p{L}", r"\p{N}"), 1):
            found = tiktoken.Encoding("class", pat_str=what, mergeable_ranks=one, special_tokens={}).encode_ordinary(every)
            self.kind[np.frombuffer(bytes(found).decode().encode("utf-32-le"), dtype=np.uint32)] = n
        self.pattern = pattern
        self.forget()

    @cached_property
    def con(self):
        import duckdb

        con = duckdb.connect()
        con.execute("SET threads = 1; SET memory_limit = '250MB'; SET temp_directory = ''; SET enable_progress_bar = false")
        merges, vocab = merge_table(self.ranks), pa.table({"id": list(self.ranks.values()), "hx": [t.hex() for t in self.ranks]})
        con.register("merges_", merges)
        con.register("vocab_", vocab)
        con.execute("CREATE TABLE merges AS FROM merges_; CREATE TABLE vocab AS FROM vocab_")
        return con

    @cached_property
    def library(self):
        import tiktoken

        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.many, self.more = np.zeros(0, np.int32), np.zeros(0, np.int64), ([], [])
        self.hits = np.zeros(0, np.int64)

    def shed(self) -> None:
        """Forget words that were met once only."""
        keep = np.flatnonzero(self.hits > 1)
        if len(keep) * 2 > len(self.hits):
            return self.forget()
        many = self.many[keep]
        ids = self.flat[np.arange(many.sum()) + np.repeat(self.start[keep] - np.cumsum(many) + many, many)]
        words = list(self.index)  # in the order in which they came
        self.forget()
        self.keep([words[i] for i in keep.tolist()], ids, many)
        self.settle()

    def starts(self, code: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        """Where words of public_tokenizers.PATTERN start in the code points of texts laid end to end.

        text_start marks each text's first code point; no word crosses one.
        """
        n, kind = len(code), self.kind[code]
        new = text_start.copy()
        new[1:] |= kind[1:] != kind[:-1]
        ends = np.append(new[1:], True)  # the last of a run
        text_end = np.append(text_start[1:], True)
        space = kind == 1
        # The last of a run of spaces stands alone, or, if it is U+0020, with what follows.
        last = space & ends & ~text_end
        new |= last
        after = np.flatnonzero(last & (code == 32)) + 1
        new[after] = False
        # An apostrophe that opens a run and that some letters follow. It doesn't after a space, which it would join.
        quote = np.flatnonzero(new & (code == 39) & ends & ~text_end)
        at = lambda i: np.where(i < n, code[np.minimum(i, n - 1)], 0)
        a, b = at(quote + 1), at(quote + 2)
        b = np.where(text_end[np.minimum(quote + 1, n - 1)], 0, b)
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = np.isin(a * 0x110000 + b, [ord(x) * 0x110000 + ord(y) for x, y in ("re", "ve", "ll")])
        for hit, length in ((quote[short], 2), (quote[long], 3)):
            new[hit + 1] = False
            past = hit + length
            new[past[past < n]] = True
        return np.flatnonzero(new)

    def words(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """All words of some texts as UTF-8, and how many each text has."""
        import public_tokenizers

        if self.pattern != public_tokenizers.PATTERN:
            import regex

            cut = [regex.findall(self.pattern, t) for t in texts]
            return [w.encode() for c in cut for w in c], np.array([len(c) for c in cut])
        whole = "".join(texts)
        if not whole:
            return [], np.zeros(len(texts), dtype=np.int64)
        size = np.array([len(t) for t in texts])
        first = np.cumsum(size) - size
        opens = np.zeros(len(whole), dtype=bool)
        opens[first[size > 0]] = True
        code = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        at = self.starts(code, opens)
        width = 1 + (code >= 0x80).view(np.int8) + (code >= 0x800).view(np.int8) + (code >= 0x10000).view(np.int8)
        edges = np.append(np.cumsum(width, dtype=np.int64)[at] - width[at], width.sum(dtype=np.int64)).tolist()
        raw = whole.encode()
        return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)], np.searchsorted(at, first + size) - np.searchsorted(at, first)

    def add(self, words: list[bytes]) -> None:
        """Encode words that aren't known yet."""
        groups: tuple[list, list, list] = ([], [], [])  # in the vocabulary, short, long
        for w in words:
            groups[0 if w in self.ranks else 1 + (len(w) > LONG)].append(w)
        known = np.array([self.ranks[w] for w in groups[0]], dtype=np.int64)
        self.keep(groups[0], known, np.ones(len(known), dtype=np.int64))
        for part in _parts(groups[1]):
            self.keep(part, *self.contract(part))
        if groups[2]:
            self.keep(groups[2], *self.contract_long(groups[2]))
        self.settle()

    def settle(self) -> None:
        self.flat, self.many = np.concatenate([self.flat, *self.more[0]]), np.concatenate([self.many, *self.more[1]])
        self.start = np.cumsum(self.many) - self.many
        self.hits = np.append(self.hits, np.zeros(len(self.many) - len(self.hits), dtype=np.int64))
        self.more = ([], [])

    def keep(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.index)
        self.index.update(zip(words, range(first, first + len(words)), strict=True))
        self.more[0].append(ids.astype(np.int32))
        self.more[1].append(sizes)

    def rows(self, words: list[bytes]) -> pa.Table:
        size = np.array([len(b) for b in words])
        token = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word, first = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size) - size, size)
        p = np.arange(len(token)) - first
        last = p == np.repeat(size, size) - 1
        return pa.table({"w": word, "p": p, "t": token, "q": np.where(last, -1, p + 1), "u": np.where(last, -1, np.append(token[1:], -1))})

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words laid end to end, and how many each has."""
        self.con.register("init", self.rows(words))
        return self.by_word(self.con.sql(_SHORT_SQL).to_arrow_table())

    def by_word(self, got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        got = got.sort_by("w").combine_chunks()
        ids = got["ids"].combine_chunks()
        return ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())

    def contract_steps(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As contract(); each step is a query of its own, since a recursive query would keep all steps' rows."""
        self.con.register("init", self.rows(words))
        self.con.execute("CREATE OR REPLACE TEMP TABLE s AS SELECT i.*, m.k, m.calm FROM init i LEFT JOIN merges m ON m.pair = (i.t << 32) | i.u")
        while self.con.execute("SELECT 1 FROM s WHERE k IS NOT NULL LIMIT 1").fetchone():
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE s2 AS {_LONG_SQL}")
            self.con.execute("DROP TABLE s; ALTER TABLE s2 RENAME TO s")
        return self.by_word(self.con.sql("SELECT w, list(t ORDER BY p) AS ids FROM s GROUP BY w").to_arrow_table())

    def blocks(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        """The ids of each of some blocks; equal ones are contracted once."""
        done: dict[bytes, np.ndarray] = {}
        new = list(dict.fromkeys(words))
        for part in _parts([w for w in new if len(w) <= LONG]):
            ids, sizes = self.contract(part)
            done.update(zip(part, np.split(ids, np.cumsum(sizes)[:-1]), strict=True))
        if joined := [w for w in new if len(w) > LONG]:
            ids, sizes = self.contract_steps(joined)
            done.update(zip(joined, np.split(ids, np.cumsum(sizes)[:-1]), strict=True))
        return done

    def contract_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As contract(), in blocks. Two blocks that have no token in common where they overlap become one and are contracted again."""
        half = LONG // 2
        cuts = [[(a, min(a + LONG, len(w))) for a in range(0, max(1, len(w) - half), half)] for w in words]
        known: dict[bytes, np.ndarray] = {}
        out: list[np.ndarray | None] = [None] * len(words)
        todo = list(range(len(words)))
        while todo:
            known |= self.blocks([x for i in todo for a, b in cuts[i] if (x := words[i][a:b]) not in known])
            for i in todo:
                found = [known[words[i][a:b]] for a, b in cuts[i]]
                starts = [a + np.cumsum(self.widths[ids]) - self.widths[ids] for (a, _), ids in zip(cuts[i], found, strict=True)]
                seams = [self.seam(found[j], starts[j], found[j + 1], starts[j + 1]) for j in range(len(found) - 1)]
                if -1 in seams:
                    whole = [cuts[i][0]]
                    for at, (a, b) in zip(seams, cuts[i][1:], strict=True):
                        whole[-1:] = [(whole[-1][0], b)] if at < 0 else [whole[-1], (a, b)]
                    cuts[i] = whole
                else:
                    edges = [0, *seams, len(words[i])]
                    out[i] = np.concatenate([ids[(s >= a) & (s < b)] for ids, s, a, b in zip(found, starts, edges, edges[1:], strict=False)])
            todo = [i for i in todo if out[i] is None]
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)

    @staticmethod
    def seam(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray) -> int:
        """Where the first token starts that two overlapping blocks have in common; -1 if there is none."""
        at, x, y = np.intersect1d(left_at, right_at, assume_unique=True, return_indices=True)
        same = np.flatnonzero(left[x] == right[y])
        return int(at[same[0]]) if len(same) else -1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts laid end to end, and how many each has."""
        words, per_text = self.words(texts)
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(self.index) > REMEMBERED:
            self.shed()
        w = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(w < 0).tolist()
        if new:
            self.add(list({words[i] for i in new}))
            w[new] = [self.index[words[i]] for i in new]
        self.hits += np.bincount(w, minlength=len(self.hits))
        many = self.many[w]
        end = np.cumsum(many)
        ids = self.flat[np.arange(end[-1]) + np.repeat(self.start[w] - end + many, many)]
        upto = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(upto)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of some lists of ids laid end to end."""
        out = [b""] * len(sizes)
        d = np.repeat(np.arange(len(sizes)), sizes)
        self.con.register("rows_", pa.table({"d": d, "p": np.arange(len(ids)), "id": ids}))
        got = self.con.sql(_DECODE_SQL).to_arrow_table()
        for i, x in zip(got["d"].to_pylist(), got["bytes"].to_pylist(), strict=True):
            out[i] = x
        return out


class LibraryCodec(Codec):
    """As Codec, but the tokenizer's library encodes whole texts; for operators that only need the ids.

    No words are remembered. Texts of over WHOLE characters are cut into words here, as the library's regular
    expression gives up on very long runs of spaces, and the library contracts these.
    """

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        import public_tokenizers

        if self.pattern != public_tokenizers.PATTERN:
            return super().encode(texts)
        own = super().encode
        ids = [self.library.encode_ordinary(t) if len(t) <= WHOLE else own([t])[0] for t in texts]
        sizes = np.array(list(map(len, ids)), dtype=np.int64)
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum())), sizes

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = list(map(self.library._encode_single_piece, words))
        sizes = np.array(list(map(len, ids)), dtype=np.int64)
        return np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(sizes.sum())), sizes

    contract_long = contract


_codecs: dict[tuple[type, bytes, str], Codec] = {}


def codec(content: bytes, pattern: str, kind: type[Codec] = Codec) -> Codec:
    """This worker's Codec of a vocabulary."""
    key = (kind, content, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = kind(content, pattern)
    return _codecs[key]


def _chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _parts(words: list[bytes]) -> Iterator[list[bytes]]:
    """Words in their order, in lists for one recursive query each."""
    part: list[bytes] = []
    rows = 0
    for w in words:
        if part and (len(part) == AT_ONCE or rows + len(w) ** 2 // 2 > STEPS):
            yield part
            part, rows = [], 0
        part.append(w)
        rows += len(w) ** 2 // 2
    if part:
        yield part


def _vocabulary(spark: SparkSession, path: str, pattern: str | None):
    import public_tokenizers

    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read()), pattern or public_tokenizers.PATTERN


def encode(df: DataFrame, path: str, *, text: str | Column = "text", out: str = "ids", pattern: str | None = None, decoded: str | None = None) -> DataFrame:
    """df with a column of token ids, array<int>, of a text column; the driver reads the vocabulary at path.

    With decoded, a binary column of that name has what the ids decode to, made in the same pass.

    A null text counts as empty and has no ids; an empty table gives an empty table; rows that are
    equal stay as many as they were. All columns of df are kept, one named like out is replaced.
    A text without end or a word of any length is encoded whole; only REMEMBERED bounds what a
    worker keeps between texts.
    """
    vocab, pattern = _vocabulary(df.sparkSession, path, pattern)
    rest = [c for c in df.columns if c not in (out, decoded)]
    work = df.select(row_of(rest).alias("row"), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab.value, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _chunks([len(t) for t in texts], CHUNK):
                ids, sizes = c.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                made = [batch.column("row").slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))]
                if decoded:
                    made.append(pa.array(c.decode(ids, sizes), pa.binary()))
                yield pa.RecordBatch.from_arrays(made, ["row", "ids", "decoded"][: len(made)])

    done = work.mapInArrow(run, with_row(work, "ids array<int>" + ", decoded binary" * bool(decoded)))
    return done.select(*[F.col("row").getField(c).alias(c) for c in rest], F.col("ids").alias(out), *([F.col("decoded").alias(decoded)] if decoded else []))


def decode(df: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded", pattern: str | None = None) -> DataFrame:
    """df with a binary column of the bytes that a column of ids stands for; null or no ids give no bytes.

    An id that isn't in the vocabulary stands for nothing. Other columns are kept, one named like out is replaced.
    """
    vocab, pattern = _vocabulary(df.sparkSession, path, pattern)
    rest = [c for c in df.columns if c != out]
    work = df.select(row_of(rest).alias("row"), F.coalesce(F.filter(ids, lambda x: x.isNotNull()), F.array().cast("array<int>")).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab.value, pattern)
        for batch in batches:
            lists = batch.column("ids")
            edge = lists.offsets.to_numpy()
            flat, sizes = lists.values.to_numpy(zero_copy_only=False), np.diff(edge)
            for a, b in _chunks(sizes.tolist(), CHUNK // 2):
                got = c.decode(flat[edge[a] : edge[b]], sizes[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), pa.array(got, pa.binary())], ["row", "out"])

    done = work.mapInArrow(run, with_row(work, "out binary"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in rest], F.col("out").alias(out))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text of documents and decode it again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode(docs_of(spark, sf_dir).select("doc_id", "text"), path, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
