"""Text and address functions, against the rules in plain Python."""

import random
import unicodedata
from urllib.parse import parse_qsl, urldefrag, urlencode, urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text, urls


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def all_of(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def plain_canonical(url):
    url = urldefrag(url)[0]
    p = urlsplit(url)
    if p.scheme not in ("http", "https"):
        return url
    pairs = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.lower().startswith(("utm_", "__cf_chl_")) and k.lower() not in ("fbclid", "gclid", "mc_cid", "mc_eid")]
    return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path or "/", urlencode(sorted(pairs)), ""))


URLS = [
    "https://A.Test/x/Y?b=2&a=1&utm_source=z#top", "http://a.test", "https://a.test?q=a+b&c=%7E*&d", "https://a.test/p?x=%20y&x=1&fbclid=3", "file:///tmp/a.html#x", "https://한국.test/길?키=값&__cf_chl_x=1",
    "https://u@a.test:8080/?=&&k=", "mailto:a@b.test",
]


def test_canonical(spark):
    got = all_of(spark, URLS, urls.canonical)
    assert got == [plain_canonical(u) for u in URLS]
    assert all_of(spark, got, urls.canonical) == got


def test_pattern_pages_and_sites(spark):
    assert all_of(spark, ["https://a.test/board/view12/3?b=1&A=2&utm_x=1", "https://a.test/list/p12-all.html", "https://A.test/x/9/", "https://a.test"], urls.pattern) == [
        "https://a.test/board/{item}/{n}?a&b", "https://a.test/list/{item}-all.html?", "https://a.test/x/{n}/?", "https://a.test/?",
    ]
    assert all_of(spark, ["https://a.test/x.PDF", "https://a.test/x", "ftp://a.test/x", "file:///x.html"], urls.is_page) == [False, True, False, True]
    assert all_of(spark, ["https://a.test:99/x", "https://b.test/", "mailto:x@a.test"], lambda c: urls.same_site(c, ["a.test"])) == [True, False, False]
    assert all_of(spark, ["a.test/x", " http://a ", ""], urls.target) == ["https://a.test/x", "http://a", None]


def test_absolute(spark):
    base = "https://a.test/d/e/f.html?q=1"
    refs = ["x.html", "/y", "../z", "//b.test/k", "#t", "?n=2", "https://c.test/", "", "./w/../v", "mailto:a@b", "../../../u", "g/."]
    assert all_of(spark, refs, lambda c: urls.absolute(F.lit(base), c)) == [urljoin(base, r) for r in refs]


def test_errors_and_downloads(spark):
    said = ["net::ERR_ABORTED at x", "Download is starting", "Page.goto: Timeout 30000ms exceeded", "boom"]
    assert all_of(spark, said, urls.error_kind) == ["transient", "download", "timeout", "other"]
    e = one(spark, "https://a.test/#x", lambda c: urls.download_event(c, F.lit("about:blank"), F.lit("https://a.test/")))
    assert (e.type, e.risk, e.page_url, e.page_triggered) == ("DOWNLOAD_NAVIGATION", "INFO", "https://a.test/#x", False)


def test_jamo():
    assert text.compose_jamo("ㄱㅏㅇㅣㅂ 가") == "가입 가"
    assert text.compose_jamo("ㄱㅏㄱㅏ") == "가가"
    for syllable in map(chr, range(0xAC00, 0xD7A4, 97)):
        initial, rest = divmod(ord(syllable) - 0xAC00, 588)
        vowel, final = divmod(rest, 28)
        from palimpsest.functions import fixed

        assert text.compose_jamo(fixed.INITIALS[initial] + fixed.VOWELS[vowel] + (fixed.FINALS[final - 1] if final else "")) == syllable


def test_letters(spark):
    assert text.unmask_letters("B0NUS рауment ＡＢ http://x9y.test A10B") == "BONUS payment AB http://x9y.test A10B"
    said = ["B0NUS", "a1b2c3d4e5f6g7h8i9j0", "see https://x9y.test/a1b", "plain", "W3C"]
    assert all_of(spark, said, text.inner_digit) == [True, False, False, False, True]
    assert all_of(spark, ["раypal", "привет", "hello мир"], text.mixed_script) == [True, False, False]
    source = "<!-- x --> function a() { var item1Code = 1; }" + " " * 100
    assert one(spark, source, text.inner_digit) is False
    assert all_of(spark, ["ㄱㅏ", "ㅋㅋㅋ ㅠㅠ", "가"], text.jamo_syllable) == [True, False, False]


@pytest.mark.parametrize("seed", [1, 2])
def test_plain_is_normal_form(spark, seed):
    rng = random.Random(seed)
    said = ["".join(rng.choice("aB  \t ＡﬁéÉ㎏ㄱ") for _ in range(rng.randint(0, 30))) for _ in range(50)]
    want = [" ".join(unicodedata.normalize("NFKC", s).lower().split()) for s in said]
    assert all_of(spark, said, text.plain) == want


def test_small_parsers(spark):
    assert all_of(spark, ["12.5px", " -3PX ", "auto", "1em"], text.pixels) == [12.5, -3.0, None, None]
    assert all_of(spark, ["a > b > c", "a", 'iframe[src="u"] >>> p > q'], text.parent) == ["a > b", "", 'iframe[src="u"] >>> p']
    assert all_of(spark, [" 1,234 ", "x"], text.number) == [1234, 0]
    assert all_of(spark, ["12.5초", "3", "?"], text.seconds) == [12.5, 3.0, 0.0]
    assert all_of(spark, ["a.b.co.kr", "x.test", "localhost"], text.registrable) == ["b", "x", "localhost"]
    grams = spark.createDataFrame([("ab",), ("",)], "v string").select(F.expr(text.ngrams("v")).alias("g")).collect()
    assert grams[0].g == ["^a", "ab", "b$", "^ab", "ab$", "^ab$"] and grams[1].g == []


def test_machine_tokens_end_at_other_letters_in_sql_only(spark):
    said = ['tоkеn = "f231еfbfd1fdb295f161bе24с505"', "a1b2c3d4e5f6g7h8i9j0", "-a1b2c3d4e5f6g7h8i9j0-", "W3C"]
    assert all_of(spark, said, text.inner_digit) == [True, False, False, True]
    assert all_of(spark, said, lambda c: text.inner_digit(c, ascii_words=True)) == [False, False, False, True]


def test_composed_forms_without_python(spark):
    rng = random.Random(3)
    alphabet = ["a", "0", "é", "é", "̧", "ﬁ", "가", "ᄀ", "ᅡ", "ᆨ", "Ａ", "３", "ㄱ", "я", "½", "K", "が", "𝟑", "語", "̈́", "ẛ̣"]
    said = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) for _ in range(600)] + alphabet
    assert all_of(spark, said, text.nfkc) == [unicodedata.normalize("NFKC", s) for s in said]
