"""The four detectors: hidden by transparency, out of sight, split jamo, look-alike letters.

Each row gives an array of candidates, which is exploded. Reasons are
codes; RENDERED has them in words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import fixed, text

RENDERED = {
    "OPACITY": "an opacity of 0, its own or an ancestor's, hides the element",
    "CLEAR_TEXT": "the text's colour is fully transparent",
    "SAME_COLOUR": "text and background have one colour",
    "DISPLAY_SELF": "display:none hides the element",
    "DISPLAY_ANCESTOR": "display:none of an ancestor hides the element",
    "FONT": "the font is very small",
    "FAR": "the element lies far outside of the screen",
    "JAMO": "initial and vowel of a syllable are written apart",
    "FULLWIDTH": "full-width letters or digits stand for ASCII ones",
    "MIXED": "a word mixes Latin letters with look-alike Cyrillic or Greek ones",
    "DIGIT": "a digit inside a word stands for a letter",
}


def _codes(*rules: tuple[Column, Column | str]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(code) if isinstance(code, str) else code) for hit, code in rules]), lambda c: c.isNotNull())


def far_outside(position: Column, left: Column, top: Column, rect: Column) -> Column:
    """Whether an absolute or fixed element is placed far off; an absolute one's height on the page doesn't count."""
    x, y = text.pixels(left), text.pixels(top)
    side = (x < -100) | (x > 5000)
    off = F.coalesce(side, F.lit(False)) | F.coalesce(y < -100, F.lit(False))
    zero = lambda c: F.coalesce(rect[c], F.lit(0.0))
    off |= (zero("x") + zero("width") < -100) | (zero("x") > 5000)
    off |= (position == "fixed") & ((zero("y") + zero("height") < -100) | (zero("y") > 5000))
    return position.isin("absolute", "fixed") & off


def transparent_reasons() -> Column:
    return _codes((F.col("effective_opacity") <= 0.001, "OPACITY"), (F.col("text_color_alpha") <= 0.001, "CLEAR_TEXT"), (F.col("same_text_background"), "SAME_COLOUR"))


def offscreen_reasons() -> Column:
    source = F.nullif(F.col("display_none_source"), F.lit(""))
    size = F.trim(F.replace(F.col("font_size"), F.lit("px"), F.lit(""))).try_cast("double")
    return _codes(
        (source == F.col("selector"), "DISPLAY_SELF"),
        (source != F.col("selector"), "DISPLAY_ANCESTOR"),
        (size <= 1, F.concat(F.lit("FONT:"), size.cast("string"))),
        (far_outside(F.col("position"), F.col("left"), F.col("top"), F.col("rect")), "FAR"),
    )


def jamo_reasons() -> Column:
    return _codes((text.jamo_syllable(F.col("text")), "JAMO"))


def homoglyph_reasons(*, numbered: bool = False, ascii_words: bool = False) -> Column:
    """numbered: whether a column _numbered holds text.numbered() of the text; ascii_words: see text.inner_digit()."""
    t = F.col("text")
    digit = text.inner_digit(t, F.col("_numbered") if numbered else None, ascii_words=ascii_words)
    return _codes((text.fullwidth(t), "FULLWIDTH"), (text.mixed_script(t), "MIXED"), (digit, "DIGIT"))


LETTERS = ("JAMO", "HOMOGLYPH")


def judge(rows: DataFrame, techniques: tuple[str, ...] = LETTERS, *, ascii_words: bool = False) -> DataFrame:
    """rows with what their text shows: for each technique T of the two the reasons (_T) and the normalised text (_T_text), null where there are none.

    Row by row, without a shuffle; a normalised text that nobody asks for isn't made.
    """
    if "HOMOGLYPH" in techniques:
        rows = rows.withColumn("_numbered", text.numbered(F.col("text")))
    reasons = {"JAMO": jamo_reasons, "HOMOGLYPH": lambda: homoglyph_reasons(numbered=True, ascii_words=ascii_words)}
    normal = {"JAMO": text.composed, "HOMOGLYPH": text.unmasked}
    rows = rows.select("*", *[reasons[t]().alias(f"_{t}") for t in techniques]).drop("_numbered")
    return rows.select("*", *[normal[t](F.when(F.size(f"_{t}") > 0, F.col("text"))).alias(f"_{t}_text") for t in techniques])


def judged_texts(obs: DataFrame, techniques: tuple[str, ...] = LETTERS, *, ascii_words: bool = False) -> DataFrame:
    """(text, technique, reason, normalized_text) of the distinct texts of obs in which a technique is found."""
    named = judge(obs.select("text").where("text is not null").distinct(), techniques, ascii_words=ascii_words)
    each = F.array(*[F.struct(F.lit(t).alias("technique"), F.col(f"_{t}").alias("reason"), F.col(f"_{t}_text").alias("normalized_text")) for t in techniques])
    # Of an inner explode Catalyst infers a filter below it, which would work out every reason twice.
    hits = named.select("text", F.explode_outer(F.filter(each, lambda c: F.size(c["reason"]) > 0)).alias("_c")).where(F.col("_c").isNotNull())
    return hits.select("text", "_c.*")


def detect(obs: DataFrame, techniques: tuple[str, ...] = fixed.TECHNIQUES, *, ascii_words: bool = False) -> DataFrame:
    """Candidates (url, location, evidence_text, technique, reason, normalized_text, opacity_source, display_source, rect, scan_pass, seq).

    seq orders candidates as technique, page, pass, element. Rows of a null text give no candidate of the
    two that look at texts; null numbers and flags give none of the others. Each row is looked at by itself,
    without a shuffle; obs may have been through judge(), before its rows were multiplied by passes.
    """
    rank = {t: i for i, t in enumerate(fixed.TECHNIQUES)}
    letters = tuple(t for t in techniques if t in LETTERS)
    if missing := tuple(t for t in letters if f"_{t}" not in obs.columns):
        obs = judge(obs, missing, ascii_words=ascii_words)
    css = {"TRANSPARENT": transparent_reasons, "OFFSCREEN": offscreen_reasons}
    named = obs.select("*", *[css[t]().alias(f"_{t}") for t in techniques if t in css])
    each = F.array(*[F.struct(F.lit(t).alias("technique"), F.lit(rank[t]).alias("rank"), F.col(f"_{t}").alias("reason")) for t in techniques])
    # Of an inner explode Catalyst infers a filter below it, which would work out every reason twice.
    hits = named.withColumn("_c", F.explode_outer(F.filter(each, lambda c: F.size(c["reason"]) > 0))).where(F.col("_c").isNotNull())
    kind = F.col("_c.technique")
    plain = F.lit(None).cast("string")
    for t in letters:
        plain = F.when(kind == t, F.col(f"_{t}_text")).otherwise(plain)
    return hits.select(
        "url",
        F.col("selector").alias("location"),
        F.col("text").alias("evidence_text"),
        kind.alias("technique"),
        F.col("_c.reason").alias("reason"),
        plain.alias("normalized_text"),
        F.when(kind == "TRANSPARENT", F.col("opacity_source")).alias("opacity_source"),
        F.when(kind == "OFFSCREEN", F.nullif(F.col("display_none_source"), F.lit(""))).alias("display_source"),
        F.when(kind == "OFFSCREEN", F.col("rect")).alias("rect"),
        "scan_pass",
        F.struct(F.col("_c.rank").alias("rank"), "page_ord", "pass_ord", "elem_ord").alias("seq"),
    )


def candidate_text() -> Column:
    """What a candidate says: its normalised text, or else its own; never null."""
    return F.coalesce(F.nullif(F.col("normalized_text"), F.lit("")), F.col("evidence_text"), F.lit(""))
