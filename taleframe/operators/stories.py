"""Building stories from frames, ordering and limiting detections, entities and their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleframe.functions import geometry, text


def scenes(frames: DataFrame) -> DataFrame:
    """movie, scene, images (by id and position), has_person: frames grouped by film and scene."""
    movie, scene = text.movie_and_scene(F.col("image_id"))
    named = frames.select(movie.alias("movie"), F.coalesce(scene, F.lit("default")).alias("scene"), "image_id", "pos", "has_person")
    return named.groupBy("movie", "scene").agg(F.array_sort(F.collect_list(F.struct("image_id", "pos"))).alias("images"), F.max("has_person").alias("has_person"))


def scene_bounds(frames: DataFrame) -> DataFrame:
    """movie, scene, n, first, last (by image id and position), has_person: scenes without their images."""
    movie, scene = text.movie_and_scene(F.col("image_id"))
    named = frames.select(movie.alias("movie"), F.coalesce(scene, F.lit("default")).alias("scene"), F.struct("image_id", "pos").alias("image"), "has_person")
    return named.groupBy("movie", "scene").agg(F.count("*").alias("n"), F.min("image").alias("first"), F.max("image").alias("last"), F.max("has_person").alias("has_person"))


def _packed(frames: DataFrame, least: int) -> DataFrame:
    """movie, k, s (n, first, last, scenes): the fold is over a film's scenes, so a film is the unit of work, and films are independent."""
    s = scene_bounds(frames).select("movie", F.struct("scene", "n", "has_person", F.col("first.image_id").alias("first"), F.col("last.image_id").alias("last")).alias("s"))
    films = s.groupBy("movie").agg(F.array_sort(F.collect_list("s")).alias("scenes"))
    names = "array<string>"
    story = f"struct<n:bigint,first:string,last:string,scenes:{names}>"
    kind = f"struct<n:bigint,p:boolean,first:string,scenes:{names},out:array<{story}>>"
    none = F.array().cast(names)
    start = F.struct(F.lit(0), F.lit(False), F.lit(None).cast("string"), none, F.array().cast(f"array<{story}>")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        n, p, first, held = a["n"] + x["n"], a["p"] | x["has_person"], F.coalesce(a["first"], x["first"]), F.array_append(a["scenes"], x["scene"])
        done = F.array_append(a["out"], F.struct(n, first, x["last"], held).cast(story))
        full = F.struct(F.lit(0), F.lit(False), F.lit(None).cast("string"), none, done).cast(kind)
        return F.when((n >= least) & p, full).otherwise(F.struct(n, p, first, held, a["out"]).cast(kind))

    return films.select("movie", F.posexplode(F.aggregate("scenes", start, step)["out"]).alias("k", "s"))


def pack_stories(frames: DataFrame, least: int = 5) -> DataFrame:
    """movie, k, n_images, first_image, last_image: whole scenes in string order, a story as soon as it has
    enough images and a person; what is left of a film is dropped.
    """
    return _packed(frames, least).select("movie", "k", F.col("s.n").alias("n_images"), F.col("s.first").alias("first_image"), F.col("s.last").alias("last_image"))


def story_frames(frames: DataFrame, least: int = 5) -> DataFrame:
    """movie, k, place, image_id, pos: the frames of each packed story, by scene, then by image id and position."""
    movie, scene = text.movie_and_scene(F.col("image_id"))
    named = frames.select(movie.alias("movie"), F.coalesce(scene, F.lit("default")).alias("scene"), "image_id", "pos")
    members = named.join(_packed(frames, least).select("movie", "k", F.explode("s.scenes").alias("scene")), ["movie", "scene"])
    place = F.row_number().over(Window.partitionBy("movie", "k").orderBy("scene", "image_id", "pos"))
    return members.select("movie", "k", place.alias("place"), "image_id", "pos")


def derived_stories(captions: DataFrame, least: int = 5) -> DataFrame:
    """story_id, image_ids, captions, images, has_person, detections of the stories that a table of captioned images gives.

    ``captions`` has id, pos (the order of the rows, unique), image, caption, human_annotated and detections.  Only rows
    that were annotated by machine count.  Scenes are packed into stories on ids and labels alone; images and captions join when
    the stories are known.  If no film gives a story, frames with a person make chunks of ``least`` in order; a story's id
    is its film and number, or the chunk's.
    """
    auto = captions.where(~F.coalesce("human_annotated", F.lit(False)))
    person = F.coalesce(F.exists("detections", lambda d: F.lower(d["label"]) == "person"), F.lit(False))
    frames = auto.select(F.col("id").alias("image_id"), "pos", person.alias("has_person"))
    named = lambda *c: F.concat_ws("-", *[F.col(x).cast("string") for x in c]).alias("story_id")
    members = story_frames(frames, least).select(named("movie", "k"), "place", "image_id", "pos")
    if members.isEmpty():
        chunks = fallback_stories(frames, least)
        members = _ranked_people(frames, least).join(chunks.select("chunk"), "chunk").join(frames.select("pos", "image_id"), "pos").select(named("chunk"), F.col("pos").alias("place"), "image_id", "pos")
    held = auto.select(F.col("id").alias("image_id"), "pos", "image", "caption", "detections")
    return story_arrays(members.join(held, ["image_id", "pos"]).drop("pos").withColumnRenamed("place", "pos"))


def _ranked_people(frames: DataFrame, size: int) -> DataFrame:
    """pos, chunk: frames with a person in order; ranks are a count per range of positions plus a rank inside it."""
    people = frames.where("has_person").select("pos").withColumn("bucket", F.floor(F.col("pos") / 4096))
    sums = people.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sums.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("bucket").orderBy("pos")) - 1
    return people.join(before, "bucket").select("pos", F.floor(rank / size).alias("chunk"))


def fallback_stories(frames: DataFrame, size: int = 5) -> DataFrame:
    """chunk, first_pos, last_pos: full chunks of frames with a person, in order, for data that gave no story."""
    chunks = _ranked_people(frames, size).groupBy("chunk").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return chunks.where(F.col("n") == size).select("chunk", "first_pos", "last_pos")


def order_and_number(dets: DataFrame, most: int = 40) -> DataFrame:
    """Detections of each image in reading order, numbered from 0 within their label, cut after ``most``."""
    keys = [*geometry.reading_order(*(F.col(c) for c in ("x", "y", "w", "h"))), F.col("pos")]
    ordered = dets.withColumn("place", F.row_number().over(Window.partitionBy("story_id").orderBy(*keys)))
    ordered = ordered.withColumn("label_id", F.row_number().over(Window.partitionBy("story_id", "label").orderBy("place")) - 1)
    return ordered.where(F.col("place") <= most)


def top_detections(dets: DataFrame, threshold: float, per_class: int, most: int) -> DataFrame:
    """Those scored above the threshold, at most so many of a class and of an image, best first."""
    kept = dets.where(F.col("score") > threshold)
    kept = kept.withColumn("of_class", F.row_number().over(Window.partitionBy("story_id", "label").orderBy(F.desc("score"), "pos"))).where(F.col("of_class") <= per_class)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= most)


def entity_ids(objects: DataFrame) -> DataFrame:
    """Match id of each object; matches of one member go unless it is a thing or a landmark."""
    n = objects.groupBy("match_id").agg(F.count("*").alias("members"))
    keep = (F.col("members") > 1) | F.coalesce("is_thing", F.lit(False)) | F.coalesce("is_landmark", F.lit(False))
    return objects.join(n, "match_id").where(keep)


def entity_names(rows: DataFrame) -> DataFrame:
    """entity_id, name: the first name that is not empty, by image and place."""
    return rows.where(F.col("name") != "").groupBy("entity_id").agg(F.min_by("name", F.struct("image_number", "pos")).alias("name"))


def mentioned_only(entities: DataFrame, stories: DataFrame, characters: bool = True, objects: bool = True, backgrounds: bool = True) -> DataFrame:
    """Entities that their story mentions, by kind where asked for; other kinds always stay."""
    ids = stories.select("story_id", F.explode(text.mentioned_ids(F.col("text"))).alias("entity_id")).distinct().withColumn("said", F.lit(True))
    marked = entities.join(ids, ["story_id", "entity_id"], "left")
    e = F.col("entity_id")
    free = ~F.rlike(e, F.lit("^(char|obj|bg)"))
    for prefix, asked in (("char", characters), ("obj", objects), ("bg", backgrounds)):
        if not asked:
            free = free | F.startswith(e, F.lit(prefix))
    return marked.where(free | F.coalesce("said", F.lit(False))).drop("said")


def merge_detections(objects: DataFrame, landmarks: DataFrame, fallback: DataFrame | None = None, keys: tuple[str, ...] = ("story_id", "frame")) -> DataFrame:
    """Objects and landmarks of each frame (``keys``); frames without a landmark take those of the fallback."""
    if fallback is not None:
        held = landmarks.select(*keys).distinct().withColumn("_held", F.lit(True))
        same = [fallback[k].eqNullSafe(held[k]) for k in keys]
        landmarks = landmarks.unionByName(fallback.join(held, same, "left_anti"))
    return objects.unionByName(landmarks)


def story_arrays(frames: DataFrame) -> DataFrame:
    """story_id, image_ids, captions, images, has_person, detections: a story's frames as arrays that run side by side.

    ``frames`` has story_id, pos, image_id, caption, image (struct width, height) and detections (array of structs); each
    detection gets the sides of its image, and a frame has a person if a detection's label says so.
    """
    sized = F.transform("detections", lambda d: d.withField("image_width", F.col("image.width")).withField("image_height", F.col("image.height")))
    person = F.exists("detections", lambda d: F.lower(d["label"]) == "person")
    row = F.struct("pos", "image_id", "caption", "image", F.coalesce(person, F.lit(False)).alias("has_person"), sized.alias("detections"))
    whole = frames.groupBy("story_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    part = lambda c, n: F.transform("rows", lambda r: r[c]).alias(n)
    return whole.select("story_id", part("image_id", "image_ids"), part("caption", "captions"), part("image", "images"), part("has_person", "has_person"), part("detections", "detections"))


def landmark_detections(annotations: DataFrame, least: float = 0.7, most: int = 10) -> DataFrame:
    """Landmark annotations above a score as detections, best first; the id is the annotation's place.

    ``annotations`` has image_id, pos, name, score and corners x1, y1, x2, y2 as shares of the image.
    """
    kept = annotations.where(F.col("score") >= least)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= most)
    return kept.select("image_id", "rank", F.col("pos").alias("id"), text.landmark_name(F.col("name")).alias("label"), "score", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


def resolve_boxes(landmarks: DataFrame, detections: DataFrame, required: bool = False) -> DataFrame:
    """Landmarks with the box of the detection that they name; one that names none has its own grid box, unless a name is required.

    A landmark that names a detection that is not there goes.
    """
    boxes = detections.select("image_id", F.col("global_id").alias("use_box_id"), F.struct("x", "y", "w", "h").alias("found"))
    joined = landmarks.join(boxes, ["image_id", "use_box_id"], "left")
    own = geometry.from_grid(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    done = joined.withColumn("box", F.coalesce("found", F.when(F.col("use_box_id").isNull() & F.lit(not required), own)))
    return done.where("box is not null").drop("found")
