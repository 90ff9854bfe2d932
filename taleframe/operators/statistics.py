"""Statistics of a story dataset: entities, frames, tags, phases, consistency, sentiment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleframe.functions import text
from taleframe.functions.text import bind
from taleframe.operators import names

# Pronouns by kind, as references are counted.
SUBJECT = ("he", "she", "they", "I", "we", "you")
POSSESSIVE = ("his", "her", "their", "my", "our", "your")
OBJECT = ("him", "them", "me", "us")
# Pronouns by kind, as words of a text are counted; those are lower-cased, so "I" never is.
TEXT_SUBJECT = ("I", "you", "he", "she", "it", "we", "they")
TEXT_POSSESSIVE = ("my", "your", "his", "her", "its", "our", "their")
TEXT_OBJECT = ("me", "you", "him", "her", "it", "us", "them")


def frame_stats(stories: DataFrame) -> DataFrame:
    c = F.col("frame_count")
    return stories.agg(F.min(c).alias("min_frames"), F.max(c).alias("max_frames"), F.avg(c).alias("mean_frames"), F.sum(c).alias("total_frames"), F.count(c).alias("stories"))


def annotation_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if("human_annotated").alias("human"), F.count_if(~F.col("human_annotated")).alias("auto"))


def per_image_counts(rows: DataFrame) -> DataFrame:
    """story_id, image_number, characters, objects, settings: rows of each table of each image of ``scenes``."""
    i = rows.select("story_id", F.explode("scenes").alias("i"))
    return i.select("story_id", "i.image_number", *[F.size(f"i.{c}").alias(c) for c in ("characters", "objects", "settings")])


def entity_kind(e: Column) -> Column:
    return F.when(F.startswith(e, F.lit("char")), "character").when(F.startswith(e, F.lit("bg")), "background").otherwise("object")


def unique_entities(frames: DataFrame) -> DataFrame:
    """Per story: distinct characters, objects, backgrounds; landmarks are never among the setting elements."""
    k = entity_kind(F.col("entity_id"))
    one = lambda kind: F.count(F.when(k == kind, F.col("entity_id"))).alias(f"{kind}s")
    return frames.select("story_id", "entity_id").distinct().groupBy("story_id").agg(one("character"), one("object"), one("background"), F.lit(0).alias("landmarks"))


def multi_frame_share(frames: DataFrame) -> DataFrame:
    """Per story: percentage of its entities that are in two frames or more."""
    spread = frames.groupBy("story_id", "entity_id").agg(F.countDistinct("image_number").alias("n"))
    return spread.groupBy("story_id").agg((F.avg((F.col("n") >= 2).cast("double")) * 100).alias("share"))


def survival_curve(frames: DataFrame) -> DataFrame:
    """n, share: percentage of entities in at least n frames, summed over stories of n frames and divided by all stories."""
    spread = frames.groupBy("story_id", "entity_id").agg(F.countDistinct("image_number").alias("n"))
    length = frames.groupBy("story_id").agg(F.max("image_number").alias("frames"))
    per = spread.groupBy("story_id", "n").agg(F.count("*").alias("k"))
    total = per.groupBy("story_id").agg(F.sum("k").alias("entities"))
    grid = length.select("story_id", F.explode(F.sequence(F.lit(1), "frames")).alias("at"))
    each = grid.join(per, "story_id").groupBy("story_id", "at").agg(F.sum(F.when(F.col("n") >= F.col("at"), F.col("k")).otherwise(0)).alias("k")).join(total, "story_id")
    stories = frames.agg(F.countDistinct("story_id").alias("stories"))
    return each.groupBy("at").agg(F.sum(F.col("k") * 100 / F.col("entities")).alias("s")).crossJoin(stories).select(F.col("at").alias("n"), (F.col("s") / F.col("stories")).alias("share"))


def persistence(frames: DataFrame) -> DataFrame:
    """step, kept, new: entities (no backgrounds) of frame i that were, or were not, in frame i - 1, averaged over stories that have the step."""
    real = frames.where(~F.startswith("entity_id", F.lit("bg"))).select("story_id", "entity_id", "image_number").distinct()
    before = F.lag("image_number").over(Window.partitionBy("story_id", "entity_id").orderBy("image_number"))
    seen = real.withColumn("stays", F.coalesce(before == F.col("image_number") - 1, F.lit(False)).cast("int"))
    per = seen.where("image_number > 1").groupBy("story_id", "image_number").agg(F.sum("stays").alias("kept"), F.sum(1 - F.col("stays")).alias("new"))
    steps = frames.groupBy("story_id").agg(F.max("image_number").alias("frames")).select("story_id", F.explode(F.when(F.col("frames") > 1, F.sequence(F.lit(2), "frames"))).alias("image_number"))
    both = steps.join(per, ["story_id", "image_number"], "left").fillna(0, ["kept", "new"])
    return both.groupBy((F.col("image_number") - 1).alias("step")).agg(F.avg("kept").alias("kept"), F.avg("new").alias("new"), F.count("*").alias("stories"))


def tag_statistics(stories: DataFrame) -> DataFrame:
    """Counts of references, pronouns and words of each story (story_id, text)."""
    t = F.col("text")
    counts = [c.alias(n) for n, c in text.tag_counts(t).items()]
    pronouns = [text.pronoun_refs(t, p).alias(n) for n, p in (("subject_refs", SUBJECT), ("possessive_refs", POSSESSIVE), ("pronoun_refs", SUBJECT + POSSESSIVE + OBJECT))]
    d = stories.select("story_id", *counts, *pronouns, text.word_count(text.strip_story_tags(t)).alias("words"), text.image_tag_count(t).alias("image_tags"))
    share = F.when(F.col("character_refs") > 0, F.col("pronoun_refs") * 100 / F.col("character_refs"))
    return d.withColumn("total_refs", F.col("character_refs") + F.col("object_refs") + F.col("action_refs") + F.col("setting_refs")).withColumn("pronoun_share", share)


def ungrounded_pronouns(stories: DataFrame) -> DataFrame:
    """story_id, pronoun, total, grounded, ungrounded: every word of the text that is a pronoun; no parser decides on it."""
    every = F.array(*map(F.lit, sorted(set(TEXT_SUBJECT + TEXT_POSSESSIVE + TEXT_OBJECT))))
    only = lambda a: F.filter(a, lambda x: F.array_contains(every, x))
    words = F.regexp_extract_all(F.lower(text.strip_story_tags(F.col("text"))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    refs = F.transform(F.regexp_extract_all("text", F.lit(r"(?s)<gdo char\d+[^>]*>(.*?)</gdo>"), F.lit(1)), F.lower)
    d = stories.select("story_id", only(words).alias("w"), only(refs).alias("r"))
    d = d.select("story_id", "w", "r", F.explode(F.array_distinct("w")).alias("pronoun"))
    count = lambda a: F.size(F.filter(a, lambda x: x == F.col("pronoun")))
    d = d.select("story_id", "pronoun", count("w").alias("total"), count("r").alias("grounded"))
    return d.withColumn("ungrounded", F.greatest(F.lit(0), F.col("total") - F.col("grounded")))


def tag_density_by_phase(phases: DataFrame, images: DataFrame) -> DataFrame:
    """phase, words and tags per hundred words: texts of a phase's images joined, phases in their order, absent ones 0."""
    numbers = F.flatten(F.collect_list(F.array_distinct(text.listed_images(F.col("images"))))).alias("numbers")
    listed = phases.groupBy("story_id", "narrative_phase").agg(numbers).groupBy("story_id").agg(F.collect_list(F.struct("narrative_phase", "numbers")).alias("phases"))
    shown = images.groupBy("story_id").agg(F.collect_list(F.struct("image_number", "text")).alias("shown"))
    of = lambda n: F.filter("shown", lambda i: i["image_number"] == n)
    whole = lambda p: F.array_sort(F.flatten(F.transform(p["numbers"], of)))
    each = lambda p: F.struct(p["narrative_phase"].alias("narrative_phase"), whole(p).alias("held"))
    # phases and images meet by story only, so rows that are dealt by story are not dealt again
    held = listed.join(shown, "story_id").select(F.inline_outer(F.transform("phases", each))).where(F.size("held") > 0)
    held = held.select("narrative_phase", F.array_join(F.transform("held", lambda x: x["text"]), " ").alias("text"))
    c = text.tag_counts(F.col("text"))
    sums = held.groupBy("narrative_phase").agg(F.sum(text.word_count(text.strip_story_tags(F.col("text")))).alias("words"), *[F.sum(c[n]).alias(n) for n in ("character_refs", "object_refs", "action_refs", "setting_refs")])
    order = phases.sparkSession.createDataFrame(list(enumerate(text.NARRATIVE_PHASES)), "place int, narrative_phase string")
    whole = order.join(sums, "narrative_phase", "left").fillna(0)
    rate = lambda n: F.when(F.col("words") > 0, F.col(n) * 100 / F.col("words")).otherwise(0.0).alias(f"{n}_rate")
    return whole.select("place", "narrative_phase", "words", *[rate(n) for n in ("character_refs", "object_refs", "action_refs", "setting_refs")])


def phase_completeness(phases: DataFrame) -> DataFrame:
    """Share of stories with exactly five phase rows, and of stories that have each phase, absent ones 0."""
    per = phases.groupBy("story_id").agg(F.count("*").alias("n"))
    complete = per.agg((F.avg((F.col("n") == 5).cast("double")) * 100).alias("share"), F.count("*").alias("stories"))
    order = phases.sparkSession.createDataFrame([(p,) for p in text.NARRATIVE_PHASES], "name string")
    held = phases.groupBy(F.col("narrative_phase").alias("name")).agg(F.countDistinct("story_id").alias("n"))
    each = order.join(held, "name", "left").crossJoin(complete).select("name", (F.coalesce("n", F.lit(0)) * 100 / F.col("stories")).alias("share"))
    return each.unionByName(complete.select(F.lit("complete").alias("name"), "share"))


def box_consistency(areas: DataFrame) -> DataFrame:
    """entity_id, n, cv: sample deviation over mean of an entity's box areas, over all stories; two areas or more."""
    d = areas.groupBy("entity_id").agg(F.count("*").alias("n"), F.avg("area").alias("mean"), F.stddev_samp("area").alias("sd"))
    return d.where("n >= 2 and mean > 0").select("entity_id", "n", (F.col("sd") / F.col("mean")).alias("cv"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """value, n for each whole number from the least to the greatest, empty ones too."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    grid = counts.agg(F.min("value").alias("a"), F.max("value").alias("b")).select(F.explode(F.sequence("a", "b")).alias("value"))
    return grid.join(counts, "value", "left").fillna(0, ["n"])


def trend(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("points"))


def mean_by_key(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean")).orderBy(F.desc("mean"), key)


def by_person(pronouns: DataFrame, value: str) -> DataFrame:
    """person, mean: first, second and third person; 0 for none."""
    # Grammatical person of pronouns.
    groups = {"first": ("I", "me", "my", "we", "us", "our"), "second": ("you", "your"), "third": ("he", "she", "it", "they", "him", "her", "its", "their", "them")}
    return pronouns.agg(*[F.coalesce(F.avg(F.when(F.col("pronoun").isin(*g), F.col(value))), F.lit(0.0)).alias(k) for k, g in groups.items()]).unpivot([], list(groups), "person", "mean")


def pronoun_ranking(pronouns: DataFrame, value: str) -> DataFrame:
    """pronoun, kind, mean, rank: pronouns by falling mean, with their kind; 0 for those without a value."""
    means = pronouns.groupBy("pronoun").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))
    p = F.col("pronoun")
    kind = F.when(p.isin(*TEXT_SUBJECT), "subject").when(p.isin(*TEXT_POSSESSIVE), "possessive").otherwise("object")
    # a language has few pronouns, so one window over all of them is small
    return means.select("pronoun", kind.alias("kind"), "mean", F.row_number().over(Window.orderBy(F.desc(F.round("mean", 9)), "pronoun")).alias("rank"))


def _multi_frame(images: Column, ids: Callable[[Column], Column]) -> Column:
    """Percentage of the distinct ids that are in two images or more; null without ids."""
    every = F.flatten(F.transform(images, lambda i: F.array_distinct(ids(i))))
    return bind(every, lambda e: bind(F.array_distinct(e), lambda d: F.when(F.size(d) > 0, F.size(F.filter(d, lambda x: F.size(F.filter(e, lambda y: y == x)) >= 2)) * 100 / F.size(d))))


def story_statistics(samples: DataFrame) -> DataFrame:
    """One row a story of ``samples`` (story_id, frames, cot, story): every figure that means are taken of, null where it does not count."""
    d = samples.select("story_id", "frames", "story", text.parse_scenes(F.col("cot")).alias("scenes"), text.parse_phases(F.col("cot")).alias("phases"))
    each = lambda c: F.aggregate(F.transform("scenes", lambda i: F.size(i[c])), F.lit(0), lambda a, x: a + x)
    objects = lambda i: F.filter(F.transform(i["objects"], lambda o: o["object_id"]), lambda x: ~F.startswith(x, F.lit("bg")))
    shape = d.select(
        "story_id", "frames", F.size("scenes").alias("images"), each("characters").alias("n_characters"), each("objects").alias("n_objects"), each("settings").alias("n_settings"),
        _multi_frame(F.col("scenes"), lambda i: F.transform(i["characters"], lambda c: c["character_id"])).alias("pct_chars_multi_frame"),
        _multi_frame(F.col("scenes"), objects).alias("pct_objs_multi_frame"), (F.size("phases") == 5).cast("int").alias("complete"),
    )
    tags = tag_statistics(samples.select("story_id", F.col("story").alias("text"))).drop("image_tags")
    said = ungrounded_pronouns(samples.select("story_id", F.col("story").alias("text")))
    kinds = {"pronouns": TEXT_SUBJECT + TEXT_POSSESSIVE + TEXT_OBJECT, "subject_pronouns": TEXT_SUBJECT, "possessive_pronouns": TEXT_POSSESSIVE}
    share = lambda c, k: F.sum(F.when(F.col("pronoun").isin(*k), F.col(c)))
    loose = said.groupBy("story_id").agg(*[(share("ungrounded", k) * 100 / share("total", k)).alias(f"ungrounded_{n}") for n, k in kinds.items()])
    share = F.sum("ungrounded") * 100 / F.sum("total")
    nouns = names.proper_nouns(samples.select("story_id", F.col("story").alias("text"))).groupBy("story_id").agg(share.alias("ungrounded_nouns"))
    return shape.join(tags, "story_id").join(loose, "story_id", "left").join(nouns, "story_id", "left")


def dataset_statistics(samples: DataFrame) -> DataFrame:
    """metric, value: the statistics of a dataset of samples (story_id, frames, cot, story) in long form, 0 where nothing counts.

    Nouns are those of ``names.proper_nouns``, which stands in for a tagger; shares by pronoun come as ``ungrounded_<pronoun>``.
    """
    per = story_statistics(samples)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    with_refs = lambda c: mean(F.when(F.col("character_refs") > 0, F.col(c) * 100 / F.col("character_refs")))
    an_image = lambda c: F.coalesce(F.sum(c) / F.sum("images"), F.lit(0.0))
    named = {
        "total_stories": F.count("*").cast("double"), "avg_frames_per_story": mean(F.when(F.col("frames") > 0, F.col("frames"))), "max_frames_per_story": F.coalesce(F.max("frames"), F.lit(0)).cast("double"),
        "pct_chars_multi_frame": mean("pct_chars_multi_frame"), "pct_objs_multi_frame": mean("pct_objs_multi_frame"),
        "avg_entity_refs": mean("total_refs"), "avg_char_refs": mean("character_refs"), "avg_obj_refs": mean("object_refs"), "avg_setting_refs": mean("setting_refs"), "avg_action_refs": mean("action_refs"),
        "avg_pronoun_pct": with_refs("pronoun_refs"), "avg_subject_pronoun_pct": with_refs("subject_refs"), "avg_possessive_pronoun_pct": with_refs("possessive_refs"),
        "avg_ungrounded_pronouns_pct": mean("ungrounded_pronouns"), "avg_ungrounded_subject_pronouns_pct": mean("ungrounded_subject_pronouns"), "avg_ungrounded_possessive_pronouns_pct": mean("ungrounded_possessive_pronouns"),
        "avg_ungrounded_proper_nouns_pct": mean("ungrounded_nouns"),
        "avg_chars_per_image": an_image("n_characters"), "avg_objs_per_image": an_image("n_objects"), "avg_settings_per_image": an_image("n_settings"),
        "pct_complete_narratives": mean("complete") * 100, "avg_words_per_story": mean("words"), "avg_distinct_chars": mean("distinct_characters"), "avg_char_actions": mean("character_actions"),
    }
    wide = per.agg(*[c.cast("double").alias(n) for n, c in named.items()])
    said = ungrounded_pronouns(samples.select("story_id", F.col("story").alias("text")))
    by = said.groupBy("pronoun").agg(F.avg(F.col("ungrounded") * 100 / F.col("total")).alias("value"))
    return wide.unpivot([], list(named), "metric", "value").unionByName(by.select(F.concat(F.lit("ungrounded_"), "pronoun").alias("metric"), "value"))


def final_statistics(tags: DataFrame, frames: DataFrame) -> DataFrame:
    """metric, value: the means of a dataset in long form, 0 where there is nothing to average."""
    names = ("character_refs", "object_refs", "action_refs", "setting_refs", "total_refs", "pronoun_refs", "pronoun_share", "words", "distinct_characters", "distinct_objects")
    means = tags.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(f"avg_{n}") for n in names])
    # entities are found once, for their kinds and for their frames
    k, spread = entity_kind(F.col("entity_id")), frames.groupBy("story_id", "entity_id").agg(F.countDistinct("image_number").alias("n"))
    one = lambda kind: F.count(F.when(k == kind, F.col("entity_id"))).alias(f"unique_{kind}s")
    each = spread.groupBy("story_id").agg(one("character"), one("object"), one("background"), F.lit(0).alias("unique_landmarks"), (F.avg((F.col("n") >= 2).cast("double")) * 100).alias("multi_frame_share"))
    kinds = each.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(f"avg_{n}") for n in ("unique_characters", "unique_objects", "unique_backgrounds", "unique_landmarks", "multi_frame_share")])
    wide = means.crossJoin(kinds)
    return wide.unpivot([], wide.columns, "metric", "value")
