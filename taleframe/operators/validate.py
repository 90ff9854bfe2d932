"""Checks of scene descriptions and stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleframe.functions import geometry, text


def _image_fault(i: Column, width: Column, height: Column) -> Column:
    """The first rule that one image of a description breaks."""
    none_but = lambda rows, test: F.exists(rows, lambda r: ~test(r))
    boxed = lambda r: geometry.box_is_valid(r["bounding_box"], width, height)
    return F.coalesce(
        F.when(none_but(i["characters"], lambda c: F.startswith(c["character_id"], F.lit("char"))), F.lit("character id")),
        F.when(none_but(i["objects"], lambda o: F.rlike(o["object_id"], F.lit("^(obj|lm|bg)"))), F.lit("object id")),
        F.when(F.size(i["settings"]) == 0, F.lit("no setting")),
        F.when(none_but(i["characters"], boxed) | none_but(i["objects"], boxed), F.lit("bounding box")),
    )


def scene_fault(scenes: Column, phases: Column, n_images: Column, width: Column, height: Column) -> Column:
    """The first rule that a description breaks, null if none: the count of images, then ids, settings and boxes image by image, then phases."""
    in_images = F.filter(F.transform(scenes, lambda i: _image_fault(i, width, height)), lambda f: f.isNotNull())
    missing = F.array_except(F.array(*map(F.lit, text.NARRATIVE_PHASES)), F.transform(phases, lambda p: p["narrative_phase"]))
    return F.coalesce(
        F.when(F.size(scenes) != n_images, F.lit("image count")),
        F.try_element_at(in_images, F.lit(1)),
        F.when(F.size(phases) == 0, F.lit("no narrative structure")),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing phases: "), F.array_join(missing, ", "))),
    )


def story_fault(story: Column, scenes: Column, n_images: Column) -> Column:
    """Image tags must be as many as images and ids in object and action tags must be in the description."""
    known = F.flatten(F.transform(scenes, lambda i: F.concat(F.transform(i["characters"], lambda c: c["character_id"]), F.transform(i["objects"], lambda o: o["object_id"]))))
    foreign = F.array_except(text.grounding_ids(story), known)
    return F.coalesce(
        F.when(text.image_tag_count(story) != n_images, F.lit("image tags")),
        F.when(F.size(foreign) > 0, F.concat(F.lit("unknown ids: "), F.array_join(foreign, ", "))),
    )


def invalid_samples(samples: DataFrame) -> DataFrame:
    """idx, scene_fault, story_fault: samples (idx, cot, story, n_images, width, height) that break a rule, with the first one on each side."""
    d = samples.select("idx", "story", "n_images", "width", "height", text.parse_scenes(F.col("cot")).alias("scenes"), text.parse_phases(F.col("cot")).alias("phases"))
    n, scenes = F.col("n_images"), F.col("scenes")
    found = d.select("idx", scene_fault(scenes, F.col("phases"), n, F.col("width"), F.col("height")).alias("scene_fault"), story_fault(F.col("story"), scenes, n).alias("story_fault"))
    return found.where("scene_fault is not null or story_fault is not null")


def dataset_summary(rows: DataFrame) -> DataFrame:
    """Counts of samples with a wrong image count, missing tables, missing phases; ``problems`` sums the three."""
    empty = F.exists("scenes", lambda i: (F.size(i["characters"]) == 0) | (F.size(i["objects"]) == 0) | (F.size(i["settings"]) == 0))
    missing = F.size(F.array_except(F.array(*map(F.lit, text.NARRATIVE_PHASES)), F.transform("phases", lambda p: p["narrative_phase"]))) > 0
    flags = rows.select((F.size("scenes") != F.col("n_images")).alias("a"), empty.alias("b"), missing.alias("c"))
    n = {"count_mismatch": "a", "parsing": "b", "narrative": "c"}
    sums = [F.count_if(c).alias(k) for k, c in n.items()]
    total = F.count_if("a") + F.count_if("b") + F.count_if("c")
    return flags.agg(F.count("*").alias("samples"), *sums, total.alias("problems"), F.count_if(F.col("a") | F.col("b") | F.col("c")).alias("distinct_problems"))
