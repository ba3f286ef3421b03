"""What surrounds a candidate: visible equals, repetition over the site, neighbouring texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import text
from palimpsest.operators.detect import candidate_text
from palimpsest.operators.model import key_of
from palimpsest.plans.storage import cleaned, together, written


def visibly_rendered() -> Column:
    """Whether an observation can be read on the screen; what isn't stated counts as visible, but for the viewport."""
    yes = lambda c: F.coalesce(c, F.lit(True))
    size = F.trim(F.replace(F.col("font_size"), F.lit("px"), F.lit(""))).try_cast("double")
    return (
        F.nullif(F.col("display_none_source"), F.lit("")).isNull()
        & yes(F.col("effective_opacity") > 0.001)
        & yes(F.col("text_color_alpha") > 0.001)
        & ~F.coalesce(F.col("same_text_background"), F.lit(False))
        & yes(~F.lower("visibility").isin("hidden", "collapse"))
        & yes(size > 1)
        & F.coalesce(F.col("in_viewport"), F.lit(False))
    )


def plain_text(obs: DataFrame) -> Column:
    """The plain form of an observation's text, or the column _plain that holds it: made before rows were multiplied by passes."""
    return F.col("_plain") if "_plain" in obs.columns else text.plain(F.col("text"))


def said_key() -> Column:
    """The hash of what a candidate says, which stands for it in counts."""
    return key_of(text.plain(candidate_text()))


def visible_texts(obs: DataFrame) -> DataFrame:
    """(url, said, places): in how many places of a page a text can be read."""
    seen = obs.where(visibly_rendered()).select("url", plain_text(obs).alias("said"), "selector").where("said <> ''")
    return seen.groupBy("url", "said").agg(F.count_distinct("selector").alias("places"))


def with_visible(merged: DataFrame, obs: DataFrame) -> DataFrame:
    """merged with said_key and visible_equivalent_count. Texts are compared by their hashes."""
    keyed = merged if "said_key" in merged.columns else merged.withColumn("said_key", said_key())
    seen = obs.where(visibly_rendered()).select("url", plain_text(obs).alias("said"), "selector").where("said <> ''").select("url", key_of(F.col("said")).alias("said_key"), "selector")
    places = seen.groupBy("url", "said_key").agg(F.count_distinct("selector").alias("places"))
    return keyed.join(places, ["url", "said_key"], "left").withColumn("visible_equivalent_count", F.coalesce("places", F.lit(0)).cast("long")).drop("places")


def total_pages(obs: DataFrame) -> DataFrame:
    """One row: how many pages there are, one at least."""
    return obs.where("url <> ''").agg(F.greatest(F.count_distinct("url"), F.lit(1)).alias("total_pages"))


def with_repetition(merged: DataFrame, pages: DataFrame) -> DataFrame:
    """merged with how many pages repeat a candidate (by place and text, by place, by text), and how many techniques met there.

    Texts are compared by their hashes. merged is read and shuffled several times, so it should be a written table of few columns.
    """
    said = merged if "said_key" in merged.columns else merged.withColumn("said_key", said_key())
    by = lambda keys, name: said.groupBy(*keys).agg(F.count_distinct("url").alias(name))
    joined = said
    for keys, name in ((["technique", "location", "said_key"], "exact_repeat_count"), (["technique", "location"], "location_repeat_count"), (["technique", "said_key"], "text_repeat_count")):
        k = by(keys, name).alias("k")
        on = [F.col(f"c.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys]
        joined = joined.alias("c").join(k, on).select("c.*", F.col(name))
    met = said.groupBy("url", "location").agg(F.collect_set("technique").alias("techniques")).alias("m")
    joined = joined.alias("c").join(met, F.col("c.url").eqNullSafe(F.col("m.url")) & F.col("c.location").eqNullSafe(F.col("m.location"))).select("c.*", "m.techniques")
    css = F.size(F.array_except("techniques", F.array(F.lit("TRANSPARENT"), F.lit("OFFSCREEN")))) == 0
    # pages has one row.
    return (
        joined.join(F.broadcast(pages))
        .withColumn("repeat_count", F.greatest("exact_repeat_count", "location_repeat_count"))
        .withColumn("repeat_ratio", F.col("repeat_count") / F.col("total_pages"))
        .withColumn("multi_technique_count", F.size("techniques").cast("long"))
        .withColumn("independent_technique_count", F.when(css, F.lit(1)).otherwise(F.size("techniques")).cast("long"))
        .drop("techniques")
    )


NEAR, FAR, ENOUGH, LENGTH = 8, 6, 4, 900


def _neighbours(obs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(url, prefix, near): of what stands under each wanted prefix of a page (url, prefixes) the first texts that any one element there can ask for.

    An element asks for so many different texts (MOST) of others than itself. So of one selector the first MOST texts will
    do, and of one text its first place and its first one of another selector; of these, an element's own are MOST at
    most, and of the others each text comes up twice at most. Texts are cut to what a context holds, and told apart by hashes.
    """
    most = max(NEAR, FAR + ENOUGH - 1)
    n = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("decimal(19,0)")
    order = n("pass_ord") * F.lit(10**18).cast("decimal(19,0)") * F.lit(10).cast("decimal(19,0)") + n("elem_ord")
    items = obs.select("url", "selector", plain_text(obs).alias("said"), order.cast("decimal(38,0)").alias("seq")).where("said <> '' AND selector LIKE '% > %'")
    items = items.select("url", "selector", "seq", key_of(F.col("said")).alias("key"), F.substring("said", 1, LENGTH).alias("said")).groupBy("url", "selector", "key", "said").agg(F.min("seq").alias("seq"))
    steps = F.split("selector", " > ")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.array_join(F.slice(steps, 1, i), " > "))
    # Dealt by pages, where all else happens; so a text is shuffled once, however many of its ancestors are wanted.
    under = items.repartition("url").join(wanted, "url").withColumn("above", above).select("*", F.explode(F.array_intersect("above", "prefixes")).alias("prefix")).drop("above", "prefixes")
    group = ["url", "prefix"]
    by = lambda keys, *at: F.row_number().over(Window.partitionBy(*group, *keys).orderBy("seq", "said", *at))
    some = under.withColumn("n", by(["selector"], "key")).where(F.col("n") <= most)
    some = some.withColumn("other", F.col("selector") != F.first("selector").over(Window.partitionBy(*group, "key").orderBy("seq", "said", "selector")))
    some = some.withColumn("n", by(["key", "other"], "selector")).where("n = 1")
    some = some.withColumn("n", by([], "selector", "key")).where(F.col("n") <= 3 * most)
    return some.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "selector", "key", "said"))), lambda x: x.dropFields("n")).alias("near"))


def with_context(merged: DataFrame, obs: DataFrame) -> DataFrame:
    """merged with context: the candidate's text twice, the page's title and the first texts beside it.

    Beside it are elements under its parent, eight at most; if they are fewer than four, also six at most
    under its parent's parent. A text counts once. The join is on the prefixes that candidates ask for,
    so the ancestors of other elements are never multiplied out; each gets a bounded number of texts, so
    candidates and their neighbours aren't either.
    """
    up = text.parent(F.col("location"))
    asked = merged.select("url", "location").distinct().select("url", "location", up.alias("p1"), text.parent(up).alias("p2"))
    wanted = asked.select("url", F.explode(F.array("p1", "p2")).alias("prefix")).where("prefix <> ''").groupBy("url").agg(F.collect_set("prefix").alias("prefixes"))
    near = _neighbours(obs, wanted)
    asked = asked.repartition("url")
    none = near.schema["near"].dataType
    for i in (1, 2):
        asked = asked.join(near.select("url", F.col("prefix").alias(f"p{i}"), F.col("near").alias(f"near{i}")), ["url", f"p{i}"], "left")
        asked = asked.withColumn(f"near{i}", F.coalesce(f"near{i}", F.array().cast(none)))
    once = lambda name: F.filter(name, lambda x, i: F.array_position(F.transform(F.col(name), lambda y: y["key"]), x["key"]) == i + 1)
    asked = asked.withColumn("near1", F.filter("near1", lambda x: x["selector"] != F.col("location")))
    asked = asked.withColumn("first", F.slice(once("near1"), 1, NEAR)).drop("near1")
    apart = lambda x: (x["selector"] != F.col("location")) & ~F.exists("first", lambda y: y["key"] == x["key"])
    asked = asked.withColumn("near2", F.when(F.size("first") < ENOUGH, F.filter("near2", apart)).otherwise(F.array().cast(none)))
    asked = asked.withColumn("beside", F.transform(F.concat("first", F.slice(once("near2"), 1, FAR)), lambda x: x["said"])).drop("first", "near2")
    # By titles first, of which a page has few, so that observations are summed up by numbers alone.
    seq = F.coalesce(F.col("pass_ord"), F.lit(-1)).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") * F.lit(10).cast("decimal(19,0)") + F.coalesce(F.col("elem_ord"), F.lit(-1))
    titles = obs.groupBy("url", "title", "page_ord").agg(F.max(seq.cast("decimal(38,0)")).alias("seq")).groupBy("url").agg(F.max_by("title", F.struct("page_ord", "seq")).alias("title"))
    said = F.filter(F.concat(F.array("title"), "beside"), lambda t: t.isNotNull() & (t != ""))
    around = asked.join(titles, "url", "left").select("url", "location", F.substring(F.array_join(said, " "), 1, LENGTH).alias("_around"))
    with cleaned(obs.sparkSession), together(obs.sparkSession):
        around = written(around.where("url IS NOT NULL AND location IS NOT NULL"), "around")
    own = candidate_text()
    whole = F.filter(F.array(own, own, F.col("_around")), lambda t: t != "")
    done = merged.join(around, ["url", "location"], "left")
    return done.withColumn("context", F.when(F.col("_around").isNotNull(), F.substring(F.array_join(whole, " "), 1, LENGTH))).drop("_around")
