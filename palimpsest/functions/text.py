"""Text functions as Column expressions; Arrow UDFs where Spark has none (compatibility normalisation, jamo, IDNA)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions import fixed

_CONFUSABLE = "".join(fixed.CONFUSABLES)
_URL = re.compile(r"(?:https?://|www\.)\S+", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z0-9]+")


def _arrow(function: Callable[[str], str], text: Column) -> Column:
    """A function of strings over Arrow batches; null stays null. Made when it is asked for: workers import this module without a session."""

    def over(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else function(t))

    return F.pandas_udf(over, StringType())(text)


def _compatible(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def ascii_only(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")


def _ranges(points: list[int]) -> str:
    """A character class of ascending code points."""
    spans: list[list[int]] = []
    for p in points:
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"


@cache
def _unsteady() -> str:
    """What composition may change, alone or beside others; a text without any of these is in composed form.

    The class has hundreds of ranges, which are gone through for each character; so what lies in the widest gaps between them is ruled out first.
    """
    every = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    parts = [unicodedata.decomposition(chr(c)).split() for c in every]
    seconds = {int(p[1], 16) for p in parts if len(p) == 2 and not p[0].startswith("<")} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    loose = [c for c in every if c in seconds or unicodedata.combining(chr(c)) or _compatible(chr(c)) != chr(c)]
    gaps = [(a + 1, b - 1) for a, b in zip(loose, loose[1:], strict=False) if b - a > (8 if b < 0x530 else 2_000) and b < 0xD800]
    steady = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in gaps)
    return rf"(?=[^\x00-\x7F])(?=[^{steady}])" + _ranges(loose)


@cache
def _ascii_alike() -> str:
    """What has ASCII letters or digits in its composed form, but is none."""
    return r"(?=[^\x00-\x7F])" + _ranges([c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and re.search("[A-Za-z0-9]", _compatible(chr(c)))])


def nfkc(text: Column) -> Column:
    """Compatibility composition; texts that it leaves as they are for want of anything to compose don't go to Python."""
    return F.coalesce(_arrow(_compatible, F.when(text.rlike(_unsteady()), text)), text)


def casefolded(text: Column) -> Column:
    """Full case folding, as for comparing without regard to case; ASCII texts don't go to Python."""
    return F.when(ascii_only(text), F.lower(text)).otherwise(_arrow(str.casefold, F.when(~ascii_only(text), text)))


def collapse(text: Column) -> Column:
    """White space of any script as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain(text: Column) -> Column:
    """The form in which texts are compared: composed, in small letters, white space collapsed; null as empty."""
    return collapse(F.lower(nfkc(F.coalesce(text, F.lit("")))))


def fullwidth(text: Column) -> Column:
    return text.rlike("[\uff10-\uff19\uff21-\uff3a\uff41-\uff5a]")


def _mixes(text: Column, letter: str) -> Column:
    """Whether a run of such letters has an ASCII one and one that looks like one, in either order."""
    # Greek and Cyrillic are two ranges, which a text without them fails fast.
    return text.rlike("[\u0370-\u04ff]") & text.rlike(f"(?U)[A-Za-z]{letter}*[{_CONFUSABLE}]|[{_CONFUSABLE}]{letter}*[A-Za-z]")


def mixed_script(text: Column) -> Column:
    """Whether a word of Latin, Greek and Cyrillic letters has an ASCII letter and one that looks like one."""
    return _mixes(text, "[A-Za-z\u0370-\u03ff\u0400-\u04ff]")


def mixed_word(text: Column) -> Column:
    """As mixed_script, for words of any characters that count as one."""
    return _mixes(text, r"\w")


def invisible(text: Column) -> Column:
    return text.rlike(f"[{fixed.INVISIBLE}]")


def source_sample(text: Column) -> Column:
    """Whether a long text shows program or markup source."""
    low = F.lower(text)
    hits = sum((low.contains(m).cast("int") for m in fixed.SOURCE_MARKERS), F.lit(0))
    return (F.length(text) >= 120) & ((low.contains("<!--") & (hits >= 2)) | (hits >= 3))


_INNER = "[A-Za-z][0134578][A-Za-z]"
#: A boundary of words of any script, and one of ASCII words (in SQL: DuckDB's).
_EDGE, _ASCII_EDGE = r"(?U:\b)", "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def numbered(text: Column) -> Column:
    """The composed form of a text with a number in it that inner_digit could find, null for others; what it looks at."""
    return nfkc(F.when(text.rlike(r"\p{N}") & (text.rlike(_INNER) | text.rlike(_ascii_alike())), text))


def inner_digit(text: Column, whole: Column | None = None, *, ascii_words: bool = False) -> Column:
    """Whether a digit that looks like a letter stands between ASCII letters, outside of addresses and long machine tokens.

    whole may be a column that holds numbered(text): an expression with a function in Python is made once for each place it is used in.
    ascii_words: whether machine tokens also end where a letter of another script follows, as DuckDB's SQL has it.
    """
    inner, edge = _INNER, _ASCII_EDGE if ascii_words else _EDGE
    whole = numbered(text) if whole is None else whole
    bare = F.regexp_replace(whole, r"(?i)(?:https?://|www\.)(?U:\S)+", " ")
    bare = F.regexp_replace(bare, edge + "[A-Za-z0-9_-]{16,}" + edge, " ")
    # Most texts fail the first, cheap test; the others are only made where it holds.
    return F.when(whole.rlike(inner), bare.rlike(inner) & ~source_sample(text)).otherwise(False)


def jamo_syllable(text: Column) -> Column:
    """Whether an initial and a vowel stand apart where they could be a syllable."""
    # Both initials lie in few ranges, which a text without them fails fast.
    return text.rlike("[\u1100-\u1112\u3131-\u314e]") & text.rlike(f"[{fixed.INITIALS}][{fixed.VOWELS}]|[\u1100-\u1112][\u1161-\u1175]")


def _letters(match: re.Match) -> str:
    token = match[0]
    if len(token) >= 16:
        return token
    inner = [fixed.DIGIT_LETTERS.get(c, c) if a.isalpha() and b.isalpha() else c for a, c, b in zip(token, token[1:], token[2:], strict=False)]
    return token[:1] + "".join(inner) + token[-1] * (len(token) > 1)


def unmask_letters(text: str) -> str:
    """A text with look-alike letters and inner digits replaced by the letters that they stand for; addresses keep their digits."""
    text = unicodedata.normalize("NFKC", text).translate(str.maketrans(fixed.CONFUSABLES))
    out, at = [], 0
    for m in _URL.finditer(text):
        out += [_TOKEN.sub(_letters, text[at : m.start()]), m[0]]
        at = m.end()
    return "".join(out) + _TOKEN.sub(_letters, text[at:])


_SYLLABLE = re.compile(f"([{fixed.INITIALS}])([{fixed.VOWELS}])(?:([{fixed.FINALS}])(?![{fixed.VOWELS}])|([{''.join(c for c in fixed.FINALS if c not in fixed.INITIALS)}]))?")


def compose_jamo(text: str) -> str:
    """A text with jamo joined to syllables; a consonant before a vowel starts the next syllable."""

    def join(m: re.Match) -> str:
        final = m[3] or m[4]
        return chr(0xAC00 + (fixed.INITIALS.index(m[1]) * 21 + fixed.VOWELS.index(m[2])) * 28 + (fixed.FINALS.index(final) + 1 if final else 0))

    return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", _SYLLABLE.sub(join, text)))


def unmasked(text: Column) -> Column:
    return _arrow(unmask_letters, text)


def composed(text: Column) -> Column:
    return _arrow(compose_jamo, text)


def _decode_host(host: str) -> str:
    labels = []
    for label in host.strip(".").split("."):
        try:
            labels.append(label.encode("ascii").decode("idna"))
        except UnicodeError:
            labels.append(label)
    return ".".join(labels).casefold()


def decoded_host(host: Column) -> Column:
    return _arrow(_decode_host, host)


def skeleton(text: Column) -> Column:
    """A host's label in the ASCII letters that it looks like."""
    return F.translate(casefolded(nfkc(text)), "".join(fixed.HOST_CONFUSABLES), "".join(fixed.HOST_CONFUSABLES.values()))


def registrable(host: Column) -> Column:
    """The label before the public suffix."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    two = F.concat_ws(".", F.get(labels, n - 2), F.get(labels, n - 1))
    return F.when(n < 2, F.get(labels, F.lit(0))).when(two.isin(*fixed.SECOND_LEVEL) & (n >= 3), F.get(labels, n - 3)).otherwise(F.get(labels, n - 2))


def pixels(value: Column) -> Column:
    """The number of a CSS length in px, null for anything else."""
    return F.regexp_extract(value, r"(?i)^\s*(-?\d+(?:\.\d+)?)px\s*$", 1).try_cast("double")


def parent(selector: Column) -> Column:
    """A selector without its last step, '' if it has one only."""
    return F.regexp_extract(selector, "(?s)^(.*) > ", 1)


def ngrams(text: str, low: int = 2, high: int = 5) -> str:
    """SQL for the character n-grams of a column, with ^ before and $ after it; none for an empty text."""
    w = f"concat('^', {text}, '$')"
    return (
        f"if({text} = '', array(), flatten(transform(sequence({low}, {high}), n -> "
        f"if(length({w}) < n, array(), transform(sequence(1, length({w}) - n + 1), i -> substring({w}, i, n))))))"
    )


def number(text: Column) -> Column:
    """A count as it is printed, thousands parted by commas; 0 if it is none."""
    return F.coalesce(F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("bigint"), F.lit(0))


def seconds(text: Column) -> Column:
    """A duration in seconds, which may end in the Korean word for them; 0 if it is none."""
    return F.coalesce(F.regexp_replace(F.trim(text), "초$", "").try_cast("double"), F.lit(0.0))


def css_attribute(value: Column) -> Column:
    """A value as it stands between the quotes of a CSS attribute selector."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


#: Scripts that are told apart, in order, with the names that regular expressions know them by.
SCRIPTS = {
    "LATIN": "IsLatin", "CYRILLIC": "IsCyrillic", "GREEK": "IsGreek", "HANGUL": "IsHangul", "HIRAGANA": "IsHiragana", "KATAKANA": "IsKatakana", "CJK": "IsHan", "ARABIC": "IsArabic", "HEBREW": "IsHebrew", "THAI": "IsThai",
    "DEVANAGARI": "IsDevanagari",
}


def script_bucket(char: Column) -> Column:
    """The script of a letter, OTHER for one of another script, null for what is no letter."""
    out = F.lit("OTHER")
    for name, known in reversed(SCRIPTS.items()):
        out = F.when(char.rlike(rf"^\p{{{known}}}"), name).otherwise(out)
    return F.when(char.rlike(r"^\p{L}"), out)
