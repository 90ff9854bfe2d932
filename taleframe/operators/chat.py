"""Chat examples from stories and captions, prompts, and label masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleframe.functions import text

SYSTEM = "You tell grounded stories about a series of images."
#: Prompts of our own; the first is empty.
PROMPTS = ("", "Tell the story of these images.", "Write what happens in these pictures.", "Narrate the scene.", "Describe the events as a story.", "What is going on here?", "Turn these frames into a tale.", "Continue from image to image.", "Give the images a plot.", "Tell me about the people here.")
IGNORED = -100


def chosen_prompt(id_: Column, prompts: tuple[str, ...] = PROMPTS, seed: int = 42) -> Column:
    """A prompt that depends on the id and the seed only."""
    return F.element_at(F.array(*map(F.lit, prompts)), (F.pmod(F.crc32(F.concat_ws("#", id_.cast("string"), F.lit(str(seed))).cast("binary")), F.lit(len(prompts))) + 1).cast("int"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def story_examples(stories: DataFrame, most_images: int | None = None) -> DataFrame:
    """story_id, messages, images from story_id, images, chain_of_thought, story."""
    images = F.slice("images", 1, most_images) if most_images else F.col("images")
    answer = F.concat(F.lit("<think>\n"), F.col("chain_of_thought"), F.lit("\n</think>\n"), F.col("story"))
    messages = F.array(message("system", F.lit(SYSTEM)), message("user", chosen_prompt(F.col("story_id"))), message("assistant", answer))
    return stories.select("story_id", messages.alias("messages"), images.alias("images"))


def caption_examples(rows: DataFrame) -> DataFrame:
    """id, messages: the prompt, an image mark, and a line for each detection with its box to two places."""
    box = lambda d: text.placeholder_tag(d["label"], d["id"], F.lit(None).cast("string"), tuple(d["box"][c] for c in "xywh"))
    asked = F.concat(chosen_prompt(F.col("id")), F.lit("\n[IMG]\n[DETECTIONS]\n"), F.array_join(F.transform("detections", box), "\n"), F.lit("\n[/DETECTIONS]"))
    return rows.select("id", F.array(message("user", asked), message("assistant", F.col("caption"))).alias("messages"))


def frame_message(frames: DataFrame) -> DataFrame:
    """story_id, frame, content: a header, then a line for each object and each landmark of the frame."""
    line = lambda d: F.concat(F.lit("- "), d["label"], F.lit(" "), d["id"].cast("string"))
    lines = lambda landmark: F.array_join(F.transform(F.filter("detections", lambda d: d["is_landmark"] == F.lit(landmark)), line), "\n")
    return frames.select("story_id", "frame", F.concat(F.lit("Frame "), F.col("frame").cast("string"), F.lit("\nObjects:\n"), lines(False), F.lit("\nLandmarks:\n"), lines(True)).alias("content"))


def label_mask(ids: Column, ignored: tuple[int, ...]) -> Column:
    """Token ids with padding and image tokens replaced by the label that no loss is taken on."""
    return F.transform(ids, lambda x: F.when(x.isin(*ignored), IGNORED).otherwise(x))


def latest_checkpoint(paths: DataFrame) -> DataFrame:
    """The path with the greatest number after "checkpoint-"; one that can't be read counts as -1."""
    n = F.coalesce(F.regexp_extract("path", r"checkpoint-(.*)$", 1).try_cast("int"), F.lit(-1))
    return paths.agg(F.max_by("path", F.struct(n, F.col("path"))).alias("path"), F.max(n).alias("step"))
