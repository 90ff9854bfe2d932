"""Sources and sinks of story datasets: Parquet splits, text triples, JSON detections, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taleframe.functions.text import bind

STORY = (
    "story_id STRING, images ARRAY<STRUCT<bytes: BINARY, path: STRING, width: INT, height: INT>>, frame_count INT, chain_of_thought STRING, story STRING"
)
DETECTION = "id BIGINT, label STRING, score DOUBLE, image_width INT, image_height INT, box STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>, is_thing BOOLEAN, is_landmark BOOLEAN, image_id STRING"
SPLITS = ("train", "test")
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str) -> Callable:
    """Register a dataset reader under a name; a name is taken once."""

    def keep(reader: Callable) -> Callable:
        if name in REGISTRY:
            raise KeyError(f"dataset {name} is registered already")
        REGISTRY[name] = reader
        return reader

    return keep


@register("stories")
def read_stories(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Stories written by ``export_split``; the split is a partition, so others are not read."""
    if split is not None and split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    rows = spark.read.parquet(path)
    return rows.where(F.col("split") == split) if split else rows


@register("captions")
def read_captions(spark: SparkSession, path: str, annotation: str = "all") -> DataFrame:
    rows = spark.read.parquet(path)
    if annotation == "all":
        return rows
    if annotation not in ("human", "auto"):
        raise ValueError("annotation must be all, human or auto")
    return rows.where(F.col("human_annotated") if annotation == "human" else ~F.col("human_annotated"))


def by_story_id(stories: DataFrame, story_id: str) -> DataFrame:
    """The last row of an id, by the column ``pos``."""
    return stories.where(F.col("story_id") == story_id).orderBy(F.desc("pos")).limit(1)


def read_texts(spark: SparkSession, glob: str) -> DataFrame:
    """name, text of whole text files."""
    rows = spark.read.text(glob, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
    return rows


def generated_stories(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_texts(spark, f"{folder}/*.txt")
    return rows.select(F.replace("name", F.lit(".txt"), F.lit("")).alias("story_id"), F.regexp_replace(F.regexp_replace("text", r"(?U)^\s+", ""), r"(?U)\s+$", "").alias("text"))


def sample_parts(files: DataFrame) -> DataFrame:
    """idx, kind, text of files named like 12_cot.txt."""
    stem = F.regexp_replace("name", r"\.txt$", "")
    return files.where(F.rlike(stem, F.lit(r"^\d+_(cot|story|metadata)$"))).select(F.split(stem, "_")[0].cast("bigint").alias("idx"), F.split(stem, "_")[1].alias("kind"), "text")


def complete_samples(parts: DataFrame) -> DataFrame:
    """idx, cot, story, image_ids of samples that have all three files."""
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("text"))).alias(k)
    wide = parts.groupBy("idx").agg(one("cot"), one("story"), one("metadata"))
    return wide.where("cot is not null and story is not null and metadata is not null").select("idx", F.trim("cot").alias("cot"), F.trim("story").alias("story"), F.split(F.trim("metadata"), "\n", -1).alias("image_ids"))


def sample_texts(samples: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """name, text of the three files of each sample (idx, cot, story, image_ids) that is not among ``present`` (name) as a whole."""
    if present is not None:
        parts = sample_parts(present.select("name", F.lit("").alias("text")))
        whole = parts.groupBy("idx").agg(F.countDistinct("kind").alias("n")).where("n = 3")
        samples = samples.join(whole, "idx", "left_anti")
    texts = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in (("cot", F.col("cot")), ("story", F.col("story")), ("metadata", F.array_join("image_ids", "\n")))])
    each = samples.select("idx", F.explode(texts).alias("f"))
    return each.select(F.concat(F.col("idx").cast("string"), F.lit("_"), F.col("f.kind"), F.lit(".txt")).alias("name"), F.coalesce("f.text", F.lit("")).alias("text"))


def examples(stories: DataFrame, limit_images: int | None = None) -> DataFrame:
    """The five columns of an example; at most so many images."""
    images = F.slice("images", 1, limit_images) if limit_images else F.col("images")
    return stories.select("story_id", images.alias("images"), "frame_count", "chain_of_thought", "story")


def assign_split(rows: DataFrame, key: str, share: float = 0.15) -> DataFrame:
    """``rows`` with split: the first floor(n * share) rows in the order of md5(key) are test.

    The order's threshold is found from counts by hash prefix; only the prefix that holds it is ranked.
    """
    d = rows.withColumn("_order", F.md5(F.col(key).cast("string").cast("binary"))).withColumn("_bucket", F.substring("_order", 1, 3))
    sums = d.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy())
    sums = sums.select("_bucket", before.alias("_base"), F.floor(total * share).alias("_tests"))
    ranked = d.join(sums, "_bucket").withColumn("_rank", F.col("_base") + F.row_number().over(Window.partitionBy("_bucket").orderBy("_order", key)))
    return ranked.withColumn("split", F.when(F.col("_rank") <= F.col("_tests"), "test").otherwise("train")).drop("_order", "_bucket", "_base", "_tests", "_rank")


def export_split(rows: DataFrame, path: str, key: str = "story_id", share: float = 0.15) -> None:
    assign_split(rows, key, share).write.partitionBy("split").parquet(path)


def without_invalid(rows: DataFrame, invalid: DataFrame, key: str = "idx") -> DataFrame:
    """The kept samples; input files are never deleted."""
    return rows.join(invalid, key, "left_anti")


def detection_json(d: Column) -> Column:
    return F.to_json(d)


def detection_from_json(c: Column) -> Column:
    """A detection with its defaults: score 0, sides 0, label normalised; null without a box."""

    def full(d: Column) -> Column:
        known = d.withField("score", F.coalesce(d["score"], F.lit(0.0))).withField("image_width", F.coalesce(d["image_width"], F.lit(0))).withField("image_height", F.coalesce(d["image_height"], F.lit(0)))
        return F.when(d["box"].isNotNull(), known.withField("label", F.translate(d["label"], " _", "--")))

    return bind(F.from_json(c, DETECTION), full)  # read once, not once a field


def write_metrics(metrics: DataFrame, path: str, hidden: tuple[str, ...] = ()) -> None:
    metrics.where(~F.col("metric").isin(*hidden) if hidden else F.lit(True)).write.json(path)


def read_images(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """Image files of a folder; with ``most``, the first so many by path, chosen before any content is read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,gif,bmp,PNG,JPG,JPEG,GIF,BMP}").load(folder)
    if most is None:
        return rows
    return rows.join(F.broadcast(rows.select("path").orderBy("path").limit(most)), "path", "left_semi")
