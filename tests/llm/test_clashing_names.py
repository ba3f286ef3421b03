"""Every operator keeps extra columns that are named like its working ones."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, fingerprint, line_dedup, packing, quality_rules, secret_scan, simhash, stats, suffix_dedup

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
EXTRA = ["_", "row", "h", "_h", "id", "a.b", "_hashes", "_kept", "_tops", "_at", "_place", "_more", "_next_text", "d", "cut", "found", "asked", "k", "c0", "text2"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(1, "some words here " * 30), (2, "some words here " * 30), (3, None), (None, "")], "doc_id long, text string")
    return rows.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: bpe.encode(d, PATH, decoded="decoded"),
        lambda d: bpe.decode(d.withColumn("ids", F.array(F.lit(1), F.lit(None))), PATH),
        lambda d: stats.text_stats(d),
        lambda d: quality_rules.quality_by_rules(d)[0],
        lambda d: secret_scan.redact(secret_scan.scan_secrets(d, PATH)),
        lambda d: simhash.fingerprints(d),
        lambda d: line_dedup.line_dedup(d),
        lambda d: suffix_dedup.suffix_dedup(d),
        lambda d: fingerprint.with_next(fingerprint.with_sketch(d, "text", "sketch"), ["text", "sketch"]),
        lambda d: packing.token_counts(d, PATH),
        lambda d: simhash.near_dedup(d),
    ],
)
def test_extra_columns_stay(docs, operator):
    done = operator(docs)
    assert set(EXTRA) <= set(done.columns) and len(set(done.columns)) == len(done.columns)
    rows = done.select(*[F.col(f"`{c}`") for c in EXTRA]).collect()
    assert rows and all(tuple(r) == tuple(range(len(EXTRA))) for r in rows)
