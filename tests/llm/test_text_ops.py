"""BPE, secrets, statistics, rules and the classifier against plain versions."""

import random
import re

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from palimpsest.llm import bpe, classifier, quality_rules, secret_scan

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, row int"  # extra columns whose names clash with working ones


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


def odd_texts():
    rng = random.Random(4)
    letters = "ab e'strevlmdAB \n\t   　'12²½é漢🙂.,!_-​́ـ%|"
    return [None, "", "\n\n", " ", "a" * 3000, " " * 500 + "x", "ab" * 400, "don't we'll I'm 're ''s 'Sx"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(400)]


def table(spark, texts):
    return spark.createDataFrame([(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)


def test_bpe_as_the_library(spark, encoder):
    texts = odd_texts() + ["same"] * 3
    coded = bpe.encode(table(spark, texts).withColumn("k", F.monotonically_increasing_id()), PATH, decoded="back")
    rows = bpe.decode(coded, PATH).collect()
    assert len(rows) == len(texts) and set(coded.columns) == {"doc_id", "text", "row", "k", "ids", "back"}
    for r in rows:
        assert list(r.ids) == encoder.encode_ordinary(r.text or "")
        assert bytes(r.back) == bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(table(spark, texts).limit(0), PATH).count() == 0


def test_codec_sheds_words_met_once(monkeypatch, encoder):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    with open(PATH, "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(12)) for _ in range(3)]
        ids, sizes = codec.encode(texts)
        assert ids.tolist() == [i for t in texts for i in encoder.encode_ordinary(t)]
        assert sizes.tolist() == [len(encoder.encode_ordinary(t)) for t in texts]


def test_library_codec_remembers_no_words(encoder):
    with open(PATH, "rb") as f:
        codec = bpe.LibraryCodec(f.read(), public_tokenizers.PATTERN)
    texts = [t or "" for t in odd_texts()]
    ids, sizes = codec.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [encoder.encode_ordinary(t) for t in texts]
    assert not codec.index
    for text in (" " * 150_000 + "x", "a b " * 30_000):  # too long for the library's expression to be safe
        assert codec.encode(["b", text])[0].tolist() == encoder.encode_ordinary("b") + encoder.encode_ordinary(text)
    assert codec.encode([" " * 1_200_000])[1].tolist()[0] > 0
    assert [len(x) for x in codec.encode([])] == [0, 0]


def test_long_words_in_blocks(encoder):
    with open(PATH, "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(6)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "xyz", "éè漢字かな", "=-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    words = ["".join(rng.choice(x) for _ in range(rng.randint(60, 500))) for x in alphabets for _ in range(25)]
    words += [" " * n for n in (65, 96, 97, 127, 129)] + ["ab" * 400, "a" * 3000, "🙂" * 70, "".join(rng.choice(alphabets[0]) for _ in range(100_000))]
    ids, sizes = codec.contract_long([w.encode() for w in words])
    for w, got in zip(words, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert w.encode() in codec.ranks or got.tolist() == encoder._encode_single_piece(w)


def plain_base(text):
    found = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def test_secrets(spark):
    rng = random.Random(2)
    parts = ["token = ", "PASSWD:", "api_key='", "apikey", "ſecret=", "secret: api_key: abcdefgh1", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2, "abcdefgh", "é🙂", " ", '"', "=", "xY9kQ2mZ7pL4vN8wR3tB6", "token=secret=abcdefghij"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(600)] + [None, ""]
    numbered = spark.createDataFrame([(None, t, "x", i) for i, t in enumerate(texts)], SCHEMA)
    got = secret_scan.scan_secrets(numbered.withColumn("spans", F.lit(1)), PATH).collect()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == plain_base(r.text or "")
    some = {s.kind for r in got for s in r.spans}
    assert some == {"assign", "access", "hex", "random"}
    plain = {r.row: masked(r.text, r.spans) for r in got if r.text is not None}
    redacted = secret_scan.redact(secret_scan.scan_secrets(numbered, PATH)).where("text is not null").collect()
    assert {r.row: r.text for r in redacted} == plain


def masked(text, spans):
    out, at = "", 0
    for _, a, b, *_ in sorted(spans, key=lambda s: (s.start, s.end)):
        if a > at or not out and a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_random_strings_and_what_resembles_them():
    with open(PATH, "rb") as f:
        encoder = secret_scan.encoder_of(f.read())
    found = lambda t: [t[a:b] for _, a, b in secret_scan.random_spans(t, encoder)]
    key = "wJalrXUtnFEMI7K7MDENGbPxRfiCYzQ9"
    assert found(f"the key {key} leaked") == [key]
    for benign in ("d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "get_user_account_details_2", "internationalization", "4913615156729033123456", "2024-01-02_backup_folder_name"):
        assert found(f"see {benign} there") == []


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
def test_random_keys_of_few_kinds_of_characters(alphabet):
    with open(PATH, "rb") as f:
        encoder = secret_scan.encoder_of(f.read())
    rng = random.Random(7)
    keys = ["".join(rng.choice(alphabet) for _ in range(rng.randint(24, 64))) for _ in range(500)]
    assert [k for k in keys if secret_scan.random_spans(f"the key {k} leaked", encoder) != [("random", 8, 8 + len(k))]] == []
    for benign in ("HttpRequestHandlerFactoryImpl", "MAX_CONNECTION_TIMEOUT_SECONDS", "aaaaaaaaaaaaaaaaaaaaaaaa", "--------------------------", "2024-01-02-03-04-05-06"):
        assert secret_scan.random_spans(f"see {benign} there", encoder) == []


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_statistics_and_rules(spark):
    rng = random.Random(3)
    texts = odd_texts()[:60] + ["\n".join(" ".join(rng.choice(["a", "b", "é#", "x%", "C!"]) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    done, model = quality_rules.quality_by_rules(table(spark, texts).withColumn("t2", F.col("text")).withColumn("n_words", F.lit(-1)))
    rows = done.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_stats(r.t2 or "")
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_by_rules(table(spark, texts).limit(0))[0].count() == 0


def test_rules_part_good_from_bad():
    names = ["a", "b", "c", "d"]
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    votes = np.where(good[:, None], (rng.random((4000, 4)) < 0.03) * -1, (rng.random((4000, 4)) < 0.7) * -1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit_label_model(patterns, counts, names)
    assert abs(model.prior - 0.8) < 0.05 and all(e[0] < -1 for e in model.evidence.values())
    assert quality_rules.fit_label_model(patterns[::-1], counts[::-1], names) == model


def test_classifier_on_held_out_labels(spark):
    import os

    at = "/root/testdata/sf0.01"
    if not os.path.exists(at):
        pytest.skip("no test data")
    got = classifier.op7_quality_classifier(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank, y = got.score.rank(), got.quality == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / y.sum() / (~y).sum()
    assert auc > 0.98 and (got.predicted == got.quality).mean() > 0.95


def test_compiled_rules_score_as_they_read(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, 3)).round(2)
    y = ((x[:, 0] > 0.4) & (x[:, 1] <= 0.7)).astype(float)
    model = classifier.fit_rules(x, y, ["a", "b", "c"])
    assert model.rules
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = rows.select("a", "b", "c", model.score({k: F.col(k) for k in "abc"}).alias("score")).collect()
    for r in got:
        odds = model.bias + sum(w for w, conditions in model.rules if all((r[f] > cut) == above for f, above, cut in conditions))
        assert abs(r.score - 1 / (1 + np.exp(-odds))) < 1e-9


def test_classifier_edges(spark):
    texts = [None, "", "word " * 3000, "same", "same"]
    model = classifier.fit_quality(table(spark, texts), spark.createDataFrame([], "doc_id long, quality int"))
    rows = classifier.score_quality(table(spark, texts).withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    one = classifier.fit_rules(np.ones((5, 2)), np.ones(5), ["a", "b"])
    assert not one.rules and one.bias > 0
    assert classifier.score_quality(table(spark, texts).limit(0), model).count() == 0
