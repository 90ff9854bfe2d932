"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taleframe.functions import geometry, text
from taleframe.operators import chat, matching, metrics, names, sentiment, statistics, stories, validate
from taleframe.plans.fixtures import view, with_views
from taleframe.sources import story_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def columns(*names: str):
    return tuple(F.col(n) for n in names)


# --- boxes ----------------------------------------------------------------------------------------------

_PAIRS = """SELECT story_id, ref_pos, cand_pos,
  CASE WHEN u = 0 THEN CASE WHEN ax = bx AND ay = b_y THEN 1.0 ELSE 0.0 END ELSE i / u END AS iou FROM (
  SELECT story_id, ref_pos, cand_pos, i, ax, ay, bx, b_y, sa + sb - i AS u FROM (
  SELECT a.story_id, a.pos AS ref_pos, b.pos AS cand_pos, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, a.w * a.h AS sa, b.w * b.h AS sb,
    greatest(0::double, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0::double, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i
  FROM ref_det a JOIN cand_det b ON a.story_id = b.story_id AND (a.label = 'person') = (b.label = 'person')))"""


@query(f"SELECT story_id, ref_pos, cand_pos, round(iou, 6) AS iou FROM ({_PAIRS}) WHERE iou >= 0.5")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of one story and kind that overlap by half."""
    a = view(spark, sf_dir, "ref_det").select("story_id", (F.col("label") == "person").alias("p"), F.col("pos").alias("ref_pos"), F.struct("x", "y", "w", "h").alias("a"))
    b = view(spark, sf_dir, "cand_det").select("story_id", (F.col("label") == "person").alias("p"), F.col("pos").alias("cand_pos"), F.struct("x", "y", "w", "h").alias("b"))
    over = geometry.iou(columns("a.x", "a.y", "a.w", "a.h"), columns("b.x", "b.y", "b.w", "b.h"))
    return a.join(b, ["story_id", "p"]).withColumn("iou", over).where("iou >= 0.5").select("story_id", "ref_pos", "cand_pos", r6("iou").alias("iou"))


@query("""SELECT story_id, pos, trunc(x * 640)::int AS px, trunc(y * 480)::int AS py, trunc(w * 640)::int AS pw, trunc(h * 480)::int AS ph,
  ceil((x + w) * 640)::int AS crop_right, ceil((y + h) * 480)::int AS crop_bottom, trunc(x * 100)::int AS grid_x,
  greatest(0, least(trunc((y + h / 2) * 3)::int, 2)) AS band, round((trunc(x * 100) + 1) / 100, 6) AS from_grid_w, round(x / 2, 6) AS corner_x FROM ref_det""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels, crop rectangles, grid cells and thirds of boxes."""
    d = view(spark, sf_dir, "ref_det")
    x, y, w, h = columns("x", "y", "w", "h")
    px, crop = geometry.pixel_box(x, y, w, h, F.lit(640), F.lit(480)), geometry.crop_rectangle(x, y, w, h, F.lit(640), F.lit(480))
    grid = geometry.from_grid(F.lit(0), F.lit(0), geometry.to_grid(x), geometry.to_grid(y))
    corner = geometry.from_corners(x, y, x + w, y + h, F.lit(2.0), F.lit(2.0))
    return d.select(
        "story_id", "pos", px["x"].alias("px"), px["y"].alias("py"), px["w"].alias("pw"), px["h"].alias("ph"), crop["right"].alias("crop_right"), crop["bottom"].alias("crop_bottom"),
        geometry.to_grid(x).alias("grid_x"), geometry.band(y, h).alias("band"), r6(grid["w"]).alias("from_grid_w"), r6(corner["x"]).alias("corner_x"),
    )


@query("""SELECT story_id, pos, place, row_number() OVER (PARTITION BY story_id, label ORDER BY place) - 1 AS label_id FROM (
  SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY greatest(0, least(trunc((y + h / 2) * 3)::int, 2)), x + w / 2, y + h / 2, pos) AS place FROM ref_det)
  QUALIFY place <= 3""")
def reading_order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in reading order, numbered within their label and cut."""
    return stories.order_and_number(view(spark, sf_dir, "ref_det"), most=3).select("story_id", "pos", "place", "label_id")


@query("""SELECT story_id, pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY score DESC, pos) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY story_id, label ORDER BY score DESC, pos) AS k FROM ref_det WHERE score > 0.02) WHERE k <= 2) WHERE rank <= 4""")
def topk_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best detections of each class and image above a threshold."""
    return stories.top_detections(view(spark, sf_dir, "ref_det"), 0.02, 2, 4).select("story_id", "pos", "rank")


_GREEDY = f"""p AS (SELECT story_id, ref_pos, cand_pos, row_number() OVER (PARTITION BY story_id ORDER BY iou DESC, ref_pos, cand_pos) AS k FROM ({_PAIRS}) WHERE iou >= 0.5),
step(story_id, k, r, c) AS (SELECT DISTINCT story_id, 0::bigint, []::bigint[], []::bigint[] FROM p
  UNION ALL SELECT s.story_id, p.k,
    CASE WHEN list_contains(s.r, p.ref_pos) OR list_contains(s.c, p.cand_pos) THEN s.r ELSE list_append(s.r, p.ref_pos) END,
    CASE WHEN list_contains(s.r, p.ref_pos) OR list_contains(s.c, p.cand_pos) THEN s.c ELSE list_append(s.c, p.cand_pos) END
  FROM step s JOIN p ON p.story_id = s.story_id AND p.k = s.k + 1),
last AS (SELECT story_id, arg_max(r, k) AS r, arg_max(c, k) AS c FROM step GROUP BY story_id),
m AS (SELECT story_id, unnest(r) AS ref_pos, unnest(c) AS cand_pos FROM last)"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT story_id, ref_pos, cand_pos FROM m")
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of references and candidates by falling overlap."""
    return metrics.match_detections(view(spark, sf_dir, "ref_det"), view(spark, sf_dir, "cand_det"))


def _score_sql(kind: str) -> str:
    s = f"_{kind}" if kind else ""
    where = {"": "true", "character": "label = 'person'", "object": "label <> 'person'"}[kind]
    return f"""SELECT avg(p) AS p, avg(q) AS q, avg(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END) AS f, '{s}' AS s FROM (
      SELECT CASE WHEN nc = 0 THEN 1 ELSE tp::double / nc END AS p, CASE WHEN nr = 0 THEN 1 ELSE tp::double / nr END AS q FROM (
        SELECT s.story_id, (SELECT count(*) FROM ref_det x WHERE x.story_id = s.story_id AND {where}) AS nr, (SELECT count(*) FROM cand_det x WHERE x.story_id = s.story_id AND {where}) AS nc,
          (SELECT count(*) FROM m JOIN ref_det x ON x.story_id = m.story_id AND x.pos = m.ref_pos WHERE m.story_id = s.story_id AND {where}) AS tp
        FROM (SELECT DISTINCT story_id FROM ref_det INTERSECT SELECT DISTINCT story_id FROM cand_det) s))"""


@query(f"""WITH RECURSIVE {_GREEDY}, t AS ({" UNION ALL ".join(_score_sql(k) for k in ("", "character", "object"))})
SELECT concat('precision', s) AS metric, round(p, 6) AS score FROM t UNION ALL SELECT concat('recall', s), round(q, 6) FROM t UNION ALL SELECT concat('f1', s), round(f, 6) FROM t""")
def grounding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean precision, recall and F1 of stories: all boxes, people, things."""
    return metrics.grounding_scores(view(spark, sf_dir, "ref_det"), view(spark, sf_dir, "cand_det")).select("metric", r6("score").alias("score"))


@query(f"""WITH RECURSIVE {_GREEDY},
ranked AS (SELECT c.story_id, sum(CASE WHEN m.cand_pos IS NULL THEN 0 ELSE 1 END) OVER w AS seen, count(*) OVER w AS k
  FROM cand_det c LEFT JOIN m ON m.story_id = c.story_id AND m.cand_pos = c.pos WINDOW w AS (PARTITION BY c.story_id ORDER BY c.score DESC, c.pos ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT r.story_id, seen::double / k AS p, seen::double / n AS q FROM ranked r JOIN (SELECT story_id, count(*) AS n FROM ref_det GROUP BY story_id) USING (story_id)),
best AS (SELECT story_id, i, coalesce(max(CASE WHEN q >= i * 0.1::double THEN p END), 0) AS p FROM curve, range(11) t(i) GROUP BY story_id, i)
SELECT story_id, round(sum(p) / 11, 6) AS ap FROM best GROUP BY story_id
UNION ALL SELECT DISTINCT story_id, 0 FROM ref_det WHERE story_id NOT IN (SELECT story_id FROM cand_det)""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven-point average precision of each story."""
    return metrics.average_precision(view(spark, sf_dir, "ref_det"), view(spark, sf_dir, "cand_det")).select("story_id", r6("ap").alias("ap"))


# --- labels, JSON ---------------------------------------------------------------------------------------


@query("""SELECT story_id, pos, translate(label, ' _', '--') AS normal, replace(replace(replace(label, '-other-merged', ''), '-merged', ''), '-other', '') AS clean,
  CASE WHEN pos % 2 = 0 THEN lower(concat('Img', pos % 5, '-', label, '-', pos)) ELSE concat(label, '-', pos) END AS global_id, label IN ('person') AS person FROM ref_det""")
def label_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "ref_det")
    image = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("Img"), (F.col("pos") % 5).cast("string")))
    return d.select("story_id", "pos", text.normal_label(F.col("label")).alias("normal"), text.clean_label(F.col("label")).alias("clean"), text.global_id(F.col("label"), F.col("pos"), image).alias("global_id"), (F.col("label") == "person").alias("person"))


_STUFF = ", ".join(f"'{s}'" for s in text.STUFF_CLASSES)


@query(f"""SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS label, list_bool_or(list_transform([{_STUFF}], lambda s: contains(s, lower(split_part(p_name, ' ', 1))))) AS stuff FROM part""")
def stuff_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are part of the name of a stuff class."""
    label = F.lower(F.split("p_name", " ")[0])
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), text.is_stuff(label).alias("stuff"))


@query("SELECT story_id, pos, translate(label, ' _', '--') AS label, round(score, 6) AS score, round(x, 6) AS x, 0 AS image_width, pos % 2 = 0 AS is_thing FROM ref_det")
def detection_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections written as JSON and read again with their defaults."""
    d = view(spark, sf_dir, "ref_det")
    packed = F.struct(F.col("pos").alias("id"), "label", "score", F.struct("x", "y", "w", "h").alias("box"), (F.col("pos") % 2 == 0).alias("is_thing"))
    back = d.select("story_id", "pos", story_files.detection_from_json(story_files.detection_json(packed)).alias("d"))
    return back.select("story_id", "pos", "d.label", r6("d.score").alias("score"), r6("d.box.x").alias("x"), "d.image_width", "d.is_thing")


@query("""SELECT p_partkey, translate(regexp_replace(regexp_replace(concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN '_Building' ELSE '' END), '(?i)building$', ''), '\\s+$', ''), '_-', '  ') AS name,
  regexp_replace(concat('tower-hall-', p_partkey), '-[^-]*$', '') <> replace(lower(CASE WHEN p_partkey % 3 = 0 THEN 'Tower Hall' ELSE p_name END), ' ', '-') AS specific FROM part""")
def landmark_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.concat("p_name", F.when(k % 2 == 0, "_Building").otherwise(""))
    name = F.when(k % 3 == 0, "Tower Hall").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.landmark_name(raw).alias("name"), text.landmark_name_is_specific(F.concat(F.lit("tower-hall-"), k.cast("string")), name).alias("specific"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_size::double END AS x1 FROM part""")
def landmark_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with JSON somewhere inside; unreadable ones hold no landmark."""
    good = F.concat(F.lit('Sure! {"landmarks": [{"name": "'), "p_name", F.lit('", "bbox": {"x1": '), F.col("p_size").cast("string"), F.lit(', "y1": 1, "x2": 5, "y2": 6}}]} Done.'))
    found = table(spark, sf_dir, "part").select("p_partkey", text.parse_landmark_reply(F.when(F.col("p_partkey") % 4 == 0, "no {json").otherwise(good)).alias("l"))
    first = F.try_element_at("l", F.lit(1))
    return found.select("p_partkey", F.size("l").alias("n"), first["name"].alias("name"), first["bbox"]["x1"].alias("x1"))


# --- tagged stories -------------------------------------------------------------------------------------


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """story_id, text: images in order, each with its sentences."""
    lines = view(spark, sf_dir, "story_line")
    told = lines.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("image_number", "pos", "sentence"))).alias("told"))
    said = lambda n: F.array_join(F.transform(F.filter("told", lambda s: s["image_number"] == n), lambda s: s["sentence"]), " ")
    numbers = F.array_distinct(F.transform("told", lambda s: s["image_number"]))
    whole = told.select("story_id", F.transform(numbers, lambda n: F.struct(n.alias("image_number"), said(n).alias("text"))).alias("images"))
    return whole.select("story_id", "images", text.render_story(F.col("images")).alias("text"))


_TAGGED = """img AS (SELECT story_id, image_number, string_agg(sentence, ' ' ORDER BY pos) AS t FROM story_line GROUP BY story_id, image_number),
tagged AS (SELECT story_id, string_agg(concat('<gdi image', image_number, '>', chr(10), t, chr(10), '</gdi>'), chr(10) || chr(10) ORDER BY image_number) AS text FROM img GROUP BY story_id)"""


#: Pronouns as SQL lists; "I" can't meet a lower-cased word.
_REFS = "('he', 'she', 'they', 'we', 'you', 'his', 'her', 'their', 'my', 'our', 'your', 'him', 'them', 'me', 'us')"
_SUBJECTS, _POSSESSIVES = "('you', 'he', 'she', 'it', 'we', 'they')", "('my', 'your', 'his', 'her', 'its', 'our', 'their')"
_BARE = "regexp_replace(text, '<[^>]+>', '', 'g')"
_SAID = rf"""{_TAGGED}, spoken AS (SELECT story_id, unnest(regexp_extract_all(lower({_BARE}), '[\p{{L}}\p{{N}}_]+')) AS w FROM tagged),
referred AS (SELECT story_id, w, count(*) AS g FROM (SELECT story_id, lower(unnest(regexp_extract_all(text, '(?s)<gdo char\d+[^>]*>(.*?)</gdo>', 1))) AS w FROM tagged) GROUP BY ALL),
said AS (SELECT story_id, w AS pronoun, count(*) AS total, coalesce(any_value(g), 0) AS grounded, greatest(0, count(*) - coalesce(any_value(g), 0)) AS ungrounded
  FROM spoken LEFT JOIN referred USING (story_id, w) WHERE w IN {_SUBJECTS} OR w IN {_POSSESSIVES} OR w IN ('me', 'him', 'us', 'them') GROUP BY story_id, w)"""
_NAMES = rf"""clauses AS (SELECT regexp_extract_all(unnest(string_split_regex({_BARE}, '[.!?\n]+')), '\p{{L}}+') AS w FROM tagged),
caps AS (SELECT lower(w) AS word, count(*) AS uses, avg(regexp_matches(w, '^\p{{Lu}}')::int) AS share FROM (SELECT unnest(w[2:]) AS w FROM clauses) GROUP BY 1),
capital AS (SELECT story_id, lower(w) AS word, count(*) AS total FROM (SELECT story_id, unnest(regexp_extract_all({_BARE}, '\p{{L}}+')) AS w FROM tagged) WHERE length(w) > 2 AND regexp_matches(w, '^\p{{Lu}}') GROUP BY ALL),
named AS (SELECT DISTINCT story_id, lower(w) AS word FROM (SELECT story_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(text, '(?s)<gdo char\d+[^>]*>(.*?)</gdo>', 1), ' '), '\p{{L}}+')) AS w FROM tagged) WHERE length(w) > 2 AND regexp_matches(w, '^\p{{Lu}}')),
nouns AS (SELECT story_id, word, total, CASE WHEN n.word IS NULL THEN 0 ELSE total END AS grounded, CASE WHEN n.word IS NULL THEN total ELSE 0 END AS ungrounded
  FROM capital JOIN caps USING (word) LEFT JOIN named n USING (story_id, word) WHERE share >= 0.5)"""


@query(f"WITH {_TAGGED} SELECT story_id, image_number, t AS text FROM img")
def story_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories rendered with image tags and parsed again."""
    back = tagged(spark, sf_dir).select("story_id", F.explode(text.story_images(F.col("text"))).alias("i"))
    return back.select("story_id", "i.image_number", "i.text")


@query(rf"""WITH {_TAGGED} SELECT story_id, text,
  trim(regexp_replace(regexp_replace(regexp_replace(text, '<gdi image\d+>|</gdi>', '', 'g'), '<gd[oal][^>]*>|</gd[oal]>', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS plain,
  len(regexp_extract_all(text, '<gdi image\d+>')) AS images,
  trim(regexp_replace(text, '<[^>]+>', '', 'g'), ' ' || chr(10)) AS bare FROM tagged""")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories without their tags, by the story's rule and by the general one."""
    t = F.col("text")
    return tagged(spark, sf_dir).select("story_id", "text", text.strip_story_tags(t).alias("plain"), text.image_tag_count(t).alias("images"), text.strip_any_tags(t).alias("bare"))


@query(f"""WITH {_TAGGED} SELECT story_id,
  CASE story_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN substr(text, 2) ELSE '' END AS story,
  CASE story_id % 4 WHEN 0 THEN '' WHEN 3 THEN '' ELSE 'why not' END AS reasoning FROM tagged""")
def think_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut into thought and story: without tags, with a line end after the tag, without one, unclosed."""
    k = F.col("story_id") % 4
    answer = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("<think>\nwhy not\n</think>\n"), "text")).when(k == 2, F.concat(F.lit("<think>why not</think>"), "text")).otherwise(F.concat(F.lit("<think>why"), "text"))
    return tagged(spark, sf_dir).select("story_id", text.story_text(answer).alias("story"), text.reasoning_text(answer).alias("reasoning"))


@query(rf"""WITH {_TAGGED} SELECT story_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '<gd[oal]\s+([^>]+)>', 1))), ',') AS mentioned,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text, '<gd[oa] (.*?)>', 1))), ',') AS grounded FROM tagged""")
def story_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that stories mention, by either rule."""
    t = F.col("text")
    return tagged(spark, sf_dir).select("story_id", F.array_join(text.mentioned_ids(t), ",").alias("mentioned"), F.array_join(text.grounding_ids(t), ",").alias("grounded"))


@query(rf"""WITH {_TAGGED}, said AS (SELECT DISTINCT story_id, unnest(regexp_extract_all(text, '<gd[oal]\s+([^>]+)>', 1)) AS entity_id FROM tagged)
SELECT e.story_id, e.entity_id, e.image_number FROM entity_frame e WHERE entity_id LIKE 'obj%' OR EXISTS (SELECT 1 FROM said s WHERE s.story_id = e.story_id AND s.entity_id = e.entity_id)""")
def mentioned_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that their story mentions; objects stay in any case."""
    texts = tagged(spark, sf_dir).select("story_id", "text")
    return stories.mentioned_only(view(spark, sf_dir, "entity_frame"), texts, objects=False).select("story_id", "entity_id", "image_number")


@query(rf"""WITH {_TAGGED} SELECT story_id, len(regexp_extract_all(text, '(?s)<gdo char\d+[^>]*>.*?</gdo>')) AS character_refs, len(regexp_extract_all(text, '(?s)<gdo obj\d+[^>]*>.*?</gdo>')) AS object_refs,
  len(regexp_extract_all(text, '(?s)<gda[^>]*>.*?</gda>')) AS action_refs, len(regexp_extract_all(text, '(?s)<gdl[^>]*>.*?</gdl>')) AS setting_refs,
  len(list_distinct(regexp_extract_all(text, '<gdo char(\d+)', 1))) AS distinct_characters, len(list_filter(regexp_extract_all(text, '(?s)<gdo char\d+[^>]*>(.*?)</gdo>', 1), lambda r: lower(r) IN {_REFS})) AS pronoun_refs,
  len(regexp_extract_all(regexp_replace(text, '<[^>]+>', '', 'g'), '[\p{{L}}\p{{N}}_]+')) AS words FROM tagged""")
def tag_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, pronouns and words of each story."""
    return statistics.tag_statistics(tagged(spark, sf_dir)).select("story_id", "character_refs", "object_refs", "action_refs", "setting_refs", "distinct_characters", "pronoun_refs", "words")


@query(f"WITH {_SAID} SELECT story_id, pronoun, total, grounded, ungrounded FROM said")
def ungrounded_pronouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pronouns of each story, and how many no character reference grounds."""
    return statistics.ungrounded_pronouns(tagged(spark, sf_dir))


@query(f"WITH {_TAGGED}, {_NAMES} SELECT story_id, word, total, grounded, ungrounded FROM nouns")
def proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proper nouns of each story by the capitals of the whole corpus, and how many no character reference names."""
    return names.proper_nouns(tagged(spark, sf_dir))


@query(f"WITH {_TAGGED}, {_NAMES} SELECT word, uses, round(share, 6) AS share FROM caps")
def capital_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word has a capital inside sentences."""
    return names.capital_shares(tagged(spark, sf_dir)).select("word", "uses", r6("share").alias("share"))


@query(r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\s\p{Z}]+', ' ', 'g'))) AS chars,
  md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\s\p{Z}]+', ' ', 'g'))) AS digest FROM pages""")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sources without tags, white space made single."""
    t = text.clean_story(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).alias("chars"), F.md5(t.cast("binary")).alias("digest"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


# --- scene tables ---------------------------------------------------------------------------------------

_BLANK = {"characters": text.CHARACTER_HEADERS, "objects": text.OBJECT_HEADERS, "settings": text.SETTING_HEADERS}


def scene_texts(spark: SparkSession, sf_dir: str, e: DataFrame | None = None) -> DataFrame:
    """story_id, n_images, text: descriptions rendered from the entities of each image."""
    e = view(spark, sf_dir, "entity_frame") if e is None else e
    box = F.concat_ws(",", *(F.lit(v) for v in ("10", "20", "300", "400")))

    def struct(headers: tuple[str, ...], own: dict) -> Column:
        return F.struct(*[own.get(h, F.lit("")).alias(text.SNAKE[h]) for h in headers])

    character = struct(text.CHARACTER_HEADERS, {"Character ID": F.col("entity_id"), "Name": F.concat(F.lit("N "), "entity_id"), "Bounding Box": box})
    thing = struct(text.OBJECT_HEADERS, {"Object ID": F.col("entity_id"), "Description": F.lit("A thing"), "Bounding Box": box})
    setting = struct(text.SETTING_HEADERS, {"Setting Element": F.when(F.col("image_number") == 1, "Weather").otherwise("Location"), "Mood": F.lit("calm")})
    is_char = F.startswith("entity_id", F.lit("char"))
    per = e.groupBy("story_id", "image_number").agg(
        F.array_sort(F.collect_list(F.when(is_char, character))).alias("characters"), F.array_sort(F.collect_list(F.when(~is_char, thing))).alias("objects"), F.array(F.first(setting)).alias("settings")
    )
    whole = per.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("image_number", "characters", "objects", "settings"))).alias("images"), F.count("*").alias("n_images"))
    phases = F.transform(F.slice(F.array(*map(F.lit, text.NARRATIVE_PHASES)), 1, (F.lit(5) - F.col("story_id") % 2).cast("int")), lambda p, i: F.struct(p.alias("narrative_phase"), F.lit("d").alias("description"), F.lit("k").alias("key_events"), (i + 1).cast("string").alias("images")))
    return whole.select("story_id", "n_images", text.render_scenes(F.col("images"), phases).alias("text"))


_RUN = "run AS (SELECT story_id, image_number FROM (SELECT story_id, image_number, row_number() OVER (PARTITION BY story_id ORDER BY image_number) AS k FROM (SELECT DISTINCT story_id, image_number FROM entity_frame)) WHERE k = image_number)"


@query(f"""WITH {_RUN} SELECT e.story_id, e.image_number, entity_id, CASE WHEN e.image_number = 1 THEN 'Weather' ELSE 'Location' END AS setting FROM entity_frame e JOIN run USING (story_id, image_number)""")
def scene_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions rendered as tables and parsed again, up to the first missing image."""
    parsed = scene_texts(spark, sf_dir).select("story_id", F.explode(text.parse_scenes(F.col("text"))).alias("i"))
    ids = F.concat(F.transform("i.characters", lambda c: c["character_id"]), F.transform("i.objects", lambda o: o["object_id"]))
    return parsed.select("story_id", "i.image_number", F.explode(ids).alias("entity_id"), F.col("i.settings")[0]["setting_element"].alias("setting"))


@query("SELECT story_id, 5 - story_id % 2 AS phases, 'Introduction' AS first FROM (SELECT DISTINCT story_id FROM entity_frame)")
def phase_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = text.parse_phases(F.col("text"))
    return scene_texts(spark, sf_dir).select("story_id", F.size(p).cast("bigint").alias("phases"), p[0]["narrative_phase"].alias("first"))


@query(f"""WITH {_RUN}, n AS (SELECT story_id, count(DISTINCT image_number) AS n FROM entity_frame GROUP BY story_id), k AS (SELECT story_id, count(*) AS k FROM run GROUP BY story_id)
SELECT story_id, CASE WHEN coalesce(k, 0) <> n THEN 'image count' WHEN story_id % 3 = 0 THEN 'bounding box' WHEN story_id % 2 = 1 THEN 'missing phases: Conclusion' END AS fault FROM n LEFT JOIN k USING (story_id)""")
def scene_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each description breaks; the images of every third story are too narrow for its boxes."""
    d = scene_texts(spark, sf_dir).select("story_id", "n_images", text.parse_scenes(F.col("text")).alias("s"), text.parse_phases(F.col("text")).alias("p"))
    width = F.when(F.col("story_id") % 3 == 0, 250).otherwise(640)
    return d.select("story_id", validate.scene_fault(F.col("s"), F.col("p"), F.col("n_images"), width, F.lit(480)).alias("fault"))


@query(f"""WITH {_RUN}, n AS (SELECT story_id, count(DISTINCT image_number) AS n FROM entity_frame GROUP BY story_id), k AS (SELECT story_id, count(*) AS k FROM run GROUP BY story_id),
t AS (SELECT story_id, max((entity_id LIKE 'char%')::int) AS c, max((entity_id NOT LIKE 'char%')::int) AS o FROM entity_frame JOIN run USING (story_id, image_number) GROUP BY story_id, image_number),
f AS (SELECT story_id, coalesce(k, 0) <> n AS a, coalesce((SELECT bool_or(c = 0 OR o = 0) FROM t WHERE t.story_id = n.story_id), false) AS b, story_id % 2 = 1 AS c FROM n LEFT JOIN k USING (story_id))
SELECT count(*) AS samples, count_if(a) AS count_mismatch, count_if(b) AS parsing, count_if(c) AS narrative, count_if(a) + count_if(b) + count_if(c) AS problems, count_if(a OR b OR c) AS distinct_problems FROM f""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of faulty samples by kind."""
    d = scene_texts(spark, sf_dir).select("n_images", text.parse_scenes(F.col("text")).alias("scenes"), text.parse_phases(F.col("text")).alias("phases"))
    return validate.dataset_summary(d)


@query("""SELECT story_id, pos, trunc(x * 640)::int < trunc((x + w) * 640)::int AND trunc((x + w) * 640)::int <= 704 AND trunc((y + h) * 480)::int <= 528 AS valid,
  round(greatest(0, least(trunc(x * 640)::int / 640.0::double, 1)), 6) AS x FROM ref_det""")
def box_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as text, checked and read."""
    px = lambda c, s: (c * s).cast("int").cast("string")
    x, y, w, h = columns("x", "y", "w", "h")
    box = F.concat_ws(", ", px(x, 640), px(y, 480), px(x + w, 640), px(y + h, 480))
    return view(spark, sf_dir, "ref_det").select("story_id", "pos", geometry.box_is_valid(box, F.lit(640), F.lit(480)).alias("valid"), r6(geometry.parse_box(box, F.lit(640), F.lit(480))["x"]).alias("x"))


# --- building stories -----------------------------------------------------------------------------------


@query(r"""SELECT movie, scene, count(*) AS images, bool_or(has_person) AS has_person, min(image_id) AS first_image FROM (
  SELECT regexp_extract(image_id, '^(.+?)_scene_?(\d+)', 1) AS movie, regexp_extract(image_id, '^(.+?)_scene_?(\d+)', 2) AS scene, image_id, has_person FROM scene_frame) GROUP BY movie, scene""")
def movie_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames grouped by film and scene."""
    s = stories.scene_bounds(view(spark, sf_dir, "scene_frame"))
    return s.select("movie", "scene", F.col("n").alias("images"), "has_person", F.col("first.image_id").alias("first_image"))


_PACKED = r"""WITH RECURSIVE s AS (SELECT movie, scene, row_number() OVER (PARTITION BY movie ORDER BY scene) AS k, n, p, a, z FROM (
  SELECT regexp_extract(image_id, '^(.+?)_scene_?(\d+)', 1) AS movie, regexp_extract(image_id, '^(.+?)_scene_?(\d+)', 2) AS scene, count(*) AS n, bool_or(has_person) AS p, min(image_id) AS a, max(image_id) AS z FROM scene_frame GROUP BY 1, 2)),
f(movie, k, n, p, a, out_n, out_a, out_z) AS (SELECT DISTINCT movie, 0::bigint, 0::bigint, false, NULL::varchar, NULL::bigint, NULL::varchar, NULL::varchar FROM s
  UNION ALL SELECT s.movie, s.k, CASE WHEN full_ THEN 0 ELSE m END, CASE WHEN full_ THEN false ELSE q END, CASE WHEN full_ THEN NULL ELSE b END, CASE WHEN full_ THEN m END, CASE WHEN full_ THEN b END, CASE WHEN full_ THEN s.z END
  FROM (SELECT s.*, f.n + s.n AS m, f.p OR s.p AS q, coalesce(f.a, s.a) AS b, f.n + s.n >= 150 AND (f.p OR s.p) AS full_ FROM f JOIN s ON s.movie = f.movie AND s.k = f.k + 1) s)
SELECT movie, row_number() OVER (PARTITION BY movie ORDER BY k) - 1 AS k, out_n AS n_images, out_a AS first_image, out_z AS last_image FROM f WHERE out_n IS NOT NULL"""


@query(_PACKED)
def packed_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes packed greedily into stories of enough images with a person."""
    p = stories.pack_stories(view(spark, sf_dir, "scene_frame"), least=150)
    return p.select("movie", F.col("k").cast("bigint").alias("k"), F.col("n_images").cast("bigint").alias("n_images"), "first_image", "last_image")


@query(_PACKED.replace(">= 150", ">= 20").replace("SELECT movie, row_number() OVER (PARTITION BY movie ORDER BY k) - 1 AS k, out_n", "SELECT concat(movie, '-', row_number() OVER (PARTITION BY movie ORDER BY k) - 1) AS story_id, out_n"))
def derived_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of twenty images or more from a table of captioned images, with their images."""
    f = view(spark, sf_dir, "scene_frame")
    person = F.struct(F.when(F.col("has_person"), "Person").otherwise("cup").alias("label"), F.lit(0).alias("image_width"), F.lit(0).alias("image_height"))
    image = F.struct(F.lit(640).alias("width"), F.lit(480).alias("height"))
    captions = f.select(F.col("image_id").alias("id"), "pos", image.alias("image"), F.col("image_id").alias("caption"), F.lit(False).alias("human_annotated"), F.array(person).alias("detections"))
    d = stories.derived_stories(captions, 20)
    return d.select("story_id", F.size("captions").cast("long").alias("n_images"), F.col("image_ids")[0].alias("first_image"), F.element_at("captions", -1).alias("last_image"))


@query("""SELECT chunk, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT pos, (row_number() OVER (ORDER BY pos) - 1) // 5 AS chunk FROM scene_frame WHERE has_person) GROUP BY chunk HAVING count(*) = 5""")
def fallback_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of five frames with a person, for data without stories."""
    return stories.fallback_stories(view(spark, sf_dir, "scene_frame"))


@query("SELECT min(n) AS min_frames, max(n) AS max_frames, round(avg(n), 6) AS mean_frames, sum(n)::bigint AS total_frames, count(*) AS stories FROM (SELECT story_id, max(image_number) AS n FROM entity_frame GROUP BY story_id)")
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = view(spark, sf_dir, "entity_frame").groupBy("story_id").agg(F.max("image_number").alias("frame_count"))
    return statistics.frame_stats(n).withColumn("mean_frames", r6("mean_frames"))


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::varchar), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= floor(n * 0.15) THEN 'test' ELSE 'train' END AS split FROM o""")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split into train and test by the order of a hash."""
    return story_files.assign_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query("""SELECT doc_id AS idx, len(string_split(trim(text), chr(10))) AS lines FROM documents WHERE trim(text) <> ''""")
def complete_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that have all three files and are not invalid."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = F.explode(F.array(*map(F.lit, ("cot", "story", "metadata")))).alias("kind")
    files = d.select(F.col("doc_id").alias("d"), kinds, "text")
    parts = story_files.sample_parts(files.select(F.concat_ws("_", F.col("d").cast("string"), F.concat("kind", F.lit(".txt"))).alias("name"), "text"))
    kept = story_files.without_invalid(story_files.complete_samples(parts), d.where("trim(text) = ''").select(F.col("doc_id").alias("idx")))
    return kept.select("idx", F.size("image_ids").cast("bigint").alias("lines"))


# --- statistics -----------------------------------------------------------------------------------------


@query("""SELECT story_id, count(DISTINCT CASE WHEN entity_id LIKE 'char%' THEN entity_id END) AS characters, count(DISTINCT CASE WHEN entity_id LIKE 'obj%' THEN entity_id END) AS objects,
  count(DISTINCT CASE WHEN entity_id LIKE 'bg%' THEN entity_id END) AS backgrounds, 0 AS landmarks FROM entity_frame GROUP BY story_id""")
def unique_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.unique_entities(view(spark, sf_dir, "entity_frame"))


@query("SELECT story_id, round(avg((n >= 2)::int) * 100, 6) AS share FROM (SELECT story_id, entity_id, count(DISTINCT image_number) AS n FROM entity_frame GROUP BY ALL) GROUP BY story_id")
def multi_frame_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.multi_frame_share(view(spark, sf_dir, "entity_frame")).select("story_id", r6("share").alias("share"))


@query("""WITH s AS (SELECT story_id, entity_id, count(DISTINCT image_number) AS n FROM entity_frame GROUP BY ALL), f AS (SELECT story_id, max(image_number) AS f FROM entity_frame GROUP BY story_id),
t AS (SELECT story_id, count(*) AS t FROM s GROUP BY story_id), g AS (SELECT story_id, unnest(range(1, f + 1)) AS lvl FROM f),
e AS (SELECT g.story_id, lvl, count(*) FILTER (n >= lvl) AS k FROM g JOIN s USING (story_id) GROUP BY ALL)
SELECT lvl::int AS n, round(sum(k * 100.0::double / t) / (SELECT count(*) FROM f), 6) AS share FROM e JOIN t USING (story_id) GROUP BY lvl""")
def survival_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentage of entities in at least n frames."""
    return statistics.survival_curve(view(spark, sf_dir, "entity_frame")).select("n", r6("share").alias("share"))


@query("""WITH r AS (SELECT DISTINCT story_id, entity_id, image_number FROM entity_frame WHERE entity_id NOT LIKE 'bg%'), f AS (SELECT story_id, unnest(range(2, max(image_number) + 1)) AS i FROM entity_frame GROUP BY story_id),
p AS (SELECT a.story_id, a.image_number AS i, count(b.entity_id) AS kept, count(*) - count(b.entity_id) AS new FROM r a LEFT JOIN r b ON b.story_id = a.story_id AND b.entity_id = a.entity_id AND b.image_number = a.image_number - 1 GROUP BY 1, 2)
SELECT (f.i - 1)::int AS step, round(avg(coalesce(kept, 0)), 6) AS kept, round(avg(coalesce(new, 0)), 6) AS new, count(*) AS stories FROM f LEFT JOIN p USING (story_id, i) GROUP BY f.i""")
def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that stay and that are new from one frame to the next."""
    return statistics.persistence(view(spark, sf_dir, "entity_frame")).select("step", r6("kept").alias("kept"), r6("new").alias("new"), "stories")


@query(f"""WITH {_TAGGED}, ph(place, phase) AS (VALUES (0, 'Introduction'), (1, 'Development'), (2, 'Conflict'), (3, 'Turning Point'), (4, 'Conclusion')),
w AS (SELECT image_number - 1 AS place, sum(len(regexp_extract_all(regexp_replace(t, '<[^>]+>', '', 'g'), '[\\p{{L}}\\p{{N}}_]+'))) AS words, sum(len(regexp_extract_all(t, '<gdo char'))) AS c, sum(len(regexp_extract_all(t, '<gda'))) AS a FROM img GROUP BY 1)
SELECT place, phase AS narrative_phase, coalesce(words, 0)::bigint AS words, round(coalesce(c * 100.0::double / words, 0), 6) AS character_rate, round(coalesce(a * 100.0::double / words, 0), 6) AS action_rate FROM ph LEFT JOIN w USING (place)""")
def tag_density_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags per hundred words in the images of each phase."""
    t = tagged(spark, sf_dir)
    images = t.select("story_id", F.explode_outer("images").alias("i")).select("story_id", "i.image_number", "i.text")  # no story is without; explode would build them twice to ask
    phases = t.select("story_id", F.posexplode(F.array(*map(F.lit, text.NARRATIVE_PHASES))).alias("p", "narrative_phase")).select("story_id", "narrative_phase", (F.col("p") + 1).cast("string").alias("images"))
    d = statistics.tag_density_by_phase(phases, images)
    return d.select("place", "narrative_phase", "words", r6("character_refs_rate").alias("character_rate"), r6("action_refs_rate").alias("action_rate"))


@query("""WITH p AS (SELECT story_id, CASE image_number WHEN 1 THEN 'Introduction' WHEN 2 THEN 'Development' WHEN 3 THEN 'Conflict' WHEN 4 THEN 'Turning Point' ELSE 'Conclusion' END AS name FROM (SELECT DISTINCT story_id, image_number FROM entity_frame)),
n AS (SELECT count(DISTINCT story_id) AS n FROM p)
SELECT name, round(count(DISTINCT story_id) * 100.0::double / any_value(n), 6) AS share FROM p, n GROUP BY name
UNION ALL SELECT 'complete', round(count(*) FILTER (k = 5) * 100.0::double / count(*), 6) FROM (SELECT story_id, count(*) AS k FROM p GROUP BY story_id)""")
def phase_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "entity_frame").select("story_id", "image_number").distinct()
    phases = frames.select("story_id", F.element_at(F.array(*map(F.lit, text.NARRATIVE_PHASES)), F.col("image_number").cast("int")).alias("narrative_phase"))
    return statistics.phase_completeness(phases).select("name", r6("share").alias("share"))


@query("SELECT label AS entity_id, count(*) AS n, round(stddev_samp(w * h) / avg(w * h), 6) AS cv FROM ref_det GROUP BY label HAVING count(*) >= 2")
def box_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = view(spark, sf_dir, "ref_det").select(F.col("label").alias("entity_id"), (F.col("w") * F.col("h")).alias("area"))
    return statistics.box_consistency(areas).select("entity_id", "n", r6("cv").alias("cv"))


@query("SELECT v AS value, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(l_linenumber) FROM lineitem), (SELECT max(l_linenumber) FROM lineitem) + 1)) AS v) LEFT JOIN (SELECT l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY 1) USING (v)")
def frame_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("frames")), "frames")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*) AS points FROM lineitem")
def linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.trend(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), "points")


_ALPHA = {"nominal": "(a <> b)::int::double", "ordinal": "(ma - mb) * (ma - mb)", "interval": "(a - b) * (a - b)", "ratio": "(a - b) * (a - b)"}


@query(f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY item) AS m FROM ratings WHERE value IS NOT NULL),
o AS (SELECT x.value AS a, y.value AS b, sum(1.0::double / (x.m - 1)) AS c FROM s x JOIN s y ON x.item = y.item AND x.coder <> y.coder GROUP BY 1, 2),
n AS (SELECT a AS v, sum(c) AS n FROM o GROUP BY a), k AS (SELECT v, n, (sum(n) OVER (ORDER BY v) - n / 2) / sum(n) OVER () AS m FROM n),
g AS (SELECT x.v AS a, y.v AS b, x.n AS na, y.n AS nb, x.m AS ma, y.m AS mb, coalesce(o.c, 0) AS c FROM k x CROSS JOIN k y LEFT JOIN o ON o.a = x.v AND o.b = y.v), t AS (SELECT sum(c) AS t FROM g)
{" UNION ALL ".join(f"SELECT '{k}' AS level, round(1 - (sum(c * {d}) / any_value(t)) / (sum(na * nb * {d}) / (any_value(t) * (any_value(t) - 1))), 6) AS alpha FROM g, t" for k, d in _ALPHA.items())}""")
def krippendorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of three raters at four levels of measurement."""
    return metrics.krippendorff_alpha(view(spark, sf_dir, "ratings")).select("level", r6("alpha").alias("alpha"))


@query()
def final_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the whole dataset in long form."""
    return statistics.final_statistics(statistics.tag_statistics(tagged(spark, sf_dir)), view(spark, sf_dir, "entity_frame")).withColumn("value", r6("value"))


# --- embeddings and entities ----------------------------------------------------------------------------


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round((list_cosine_similarity(a.embedding::double[], b.embedding::double[]) + 1) / 2, 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id // 10 = b.vec_id // 10 AND a.vec_id < b.vec_id""")
def frame_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the vectors of one frame; a frame holds ten."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 10).alias("frame"))
    other = e.select("frame", F.col("vec_id").alias("b"), F.col("embedding").alias("e2"))
    pairs = e.join(other, "frame").where("vec_id < b")
    return pairs.select(F.col("vec_id").alias("a"), "b", F.round(geometry.similarity(F.col("embedding"), F.col("e2")), 5).alias("similarity"))


@query("""WITH s AS (SELECT story_id, pos % 2 = 1 AS left_, round(score * 100) AS s FROM ref_det),
m AS (SELECT story_id, avg(s) FILTER (left_) AS mean, stddev_pop(s) FILTER (left_) AS spread, quantile_cont(s, 0.75) FILTER (NOT left_) AS p75 FROM s GROUP BY story_id)
SELECT story_id, round(p75, 6) AS p75, p75 >= 3 AND (spread = 0 OR mean - p75 <= 0.513::double * spread) AS admitted FROM m WHERE p75 IS NOT NULL""")
def admission_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every other score of a story, in hundredths, would be admitted to a match whose last admission left the rest."""
    own, s = F.col("pos") % 2 == 0, F.round(F.col("score") * 100)
    left = F.when(~own, s)
    d = view(spark, sf_dir, "ref_det").groupBy("story_id").agg(F.collect_list(F.when(own, s)).alias("s"), F.avg(left).alias("mean"), F.stddev_pop(left).alias("spread"))
    admitted = geometry.admission(F.col("s"), F.col("mean"), F.col("spread"), 3.0, 0.513)
    return d.where("size(s) > 0").select("story_id", r6(geometry.percentile(F.col("s"), 0.75)).alias("p75"), admitted.alias("admitted"))


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as detections: fifty make a story of five frames, one label in three is a person's, and some people show a face."""
    e, label = table(spark, sf_dir, "embeddings"), F.col("label")
    name = F.when(label % 3 == 0, F.lit("person")).otherwise(F.concat(F.lit("thing"), label.cast("string")))
    face = F.when((label % 3 == 0) & (F.col("vec_id") % 4 != 0), F.slice("embedding", 1, 16))
    return e.where("label is not null").select(F.floor(F.col("vec_id") / 50).alias("story"), name.alias("label"), (F.floor(F.col("vec_id") / 10) % 5).cast("int").alias("frame"), F.col("vec_id").alias("pos"), F.col("embedding").alias("clip"), face.alias("face"))


#: Thresholds of the queries over vectors, which are less alike than crops of images.
MATCHING = {"threshold": 0.5, "face_threshold": 0.0, "factor": 0.5}


@query()
def matched_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities across frames: vectors of one label in one story, greedily matched by faces and images."""
    m = matching.match_entities(vector_frames(spark, sf_dir), **MATCHING)
    state = [r6(c).alias(c) for c in ("similarity", "spread", "face_similarity", "face_spread")]
    return m.join(matching.entity_prefixes(m), ["story", "label", "match"]).select("story", "entity_id", "member", "frame", "pos", *state)


@query()
def ranked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a story by what their last admission left; people without a face take no part and single members go."""
    m = matching.match_entities(vector_frames(spark, sf_dir), **MATCHING, require_face=True, keep_single=False)
    return matching.rank_matches(m).select("story", "label", "match", "members", "rank", r6("best").alias("best"))


@query()
def assigned_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of people by story: a face in each box, of which small ones fall away; every third person has a mask."""
    d = view(spark, sf_dir, "ref_det").where("label = 'person'")
    x, y, w, h = (F.col(c) * 1000 for c in "xywh")
    cell = lambda k: (F.col("pos") + k) % 2
    mask = F.when(F.col("pos") % 3 == 0, F.array(F.array(cell(0), cell(1)), F.array(cell(1), F.lit(1).cast("int"))))
    people = d.select(F.col("story_id").alias("frame"), "pos", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), mask.alias("mask"))
    side = w / 4 + 20
    faces = d.select(F.col("story_id").alias("frame"), F.col("pos").alias("face"), (F.lit(0.6) + F.col("score") * 4).alias("confidence"), (x + w / 3).alias("x1"), (y + h / 5).alias("y1"), (x + w / 3 + side).alias("x2"), (y + h / 5 + side * 0.8).alias("y2"))
    return matching.assign_faces(people, faces)


# --- chat and language ----------------------------------------------------------------------------------


@query("""SELECT conv_id AS story_id, 3 AS messages, sha256(concat('<think>', chr(10), 'w', conv_id, chr(10), '</think>', chr(10), string_agg(coalesce(text, ''), ' ' ORDER BY turn, role, text))) AS answer FROM conversations GROUP BY conv_id""")
def chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories as system, user and assistant messages."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    s = c.select(F.col("conv_id").alias("story_id"), F.array().cast("array<string>").alias("images"), F.concat(F.lit("w"), F.col("conv_id").cast("string")).alias("chain_of_thought"), F.array_join(F.transform("t", lambda t: t["text"]), " ").alias("story"))
    return chat.story_examples(s).select("story_id", F.size("messages").alias("messages"), F.sha2(F.element_at("messages", -1)["content"], 256).alias("answer"))


@query("""SELECT story_id, image_number AS frame, sha256(concat('Frame ', image_number, chr(10), 'Objects:', chr(10), coalesce(string_agg(concat('- ', entity_id, ' ', image_number), chr(10) ORDER BY entity_id) FILTER (entity_id NOT LIKE 'bg%'), ''),
  chr(10), 'Landmarks:', chr(10), coalesce(string_agg(concat('- ', entity_id, ' ', image_number), chr(10) ORDER BY entity_id) FILTER (entity_id LIKE 'bg%'), ''))) AS content FROM entity_frame GROUP BY story_id, image_number""")
def frame_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message that introduces each frame."""
    e = view(spark, sf_dir, "entity_frame")
    d = F.struct(F.col("entity_id").alias("label"), F.col("image_number").alias("id"), F.startswith("entity_id", F.lit("bg")).alias("is_landmark"))
    f = e.groupBy("story_id", F.col("image_number").alias("frame")).agg(F.array_sort(F.collect_list(d)).alias("detections"))
    return chat.frame_message(f).select("story_id", "frame", F.sha2("content", 256).alias("content"))


@query("SELECT doc_id, len(list_filter(t, lambda x: x <> 2)) AS kept FROM (SELECT doc_id, list_transform(range(1, 9), lambda i: (doc_id + i) % 4) AS t FROM documents)")
def label_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: ((F.col("doc_id") + i) % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(chat.label_mask(ids, (2,)), lambda x: x != chat.IGNORED)).cast("bigint").alias("kept"))


@query("SELECT concat('out/checkpoint-', max(o_orderkey)) AS path, max(o_orderkey)::int AS step FROM orders")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("out/checkpoint-"), F.when(F.col("o_orderkey") == 1, "x").otherwise(F.col("o_orderkey").cast("string"))).alias("path"))
    return chat.latest_checkpoint(o)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, candidate, reference: each assistant turn as reference of the turn before it in its conversation.

    Repeated rows of a turn meet in order of their text; the shorter side's last row stands for those it lacks.
    """
    c = table(spark, sf_dir, "conversations").where("text is not null")
    rows = lambda d, name, *order: d.select("conv_id", "turn", F.col("text").alias(name), F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(*order)).alias(f"{name}_row"))
    said = rows(c, "candidate", "text", "role").withColumnRenamed("turn", "before")
    answers = rows(c.where("role = 'assistant'"), "reference", "text")
    turns = c.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "assistant").alias("answers"))
    earlier = Window.partitionBy("conv_id").orderBy("turn")
    turns = turns.select("conv_id", "turn", "answers", F.lag("turn").over(earlier).alias("before"), F.lag("n").over(earlier).alias("said")).where("answers > 0 and before is not null")
    each = turns.select("*", F.explode(F.sequence(F.lit(1), F.greatest("answers", "said").cast("int"))).alias("k"))
    each = each.withColumns({"reference_row": F.least("k", "answers").cast("int"), "candidate_row": F.least("k", "said").cast("int")})
    both = each.join(answers, ["conv_id", "turn", "reference_row"]).join(said, ["conv_id", "before", "candidate_row"])
    return both.select(F.concat_ws("-", "conv_id", "turn", "k").alias("id"), "candidate", "reference")


_TURNS = r"""a AS (SELECT conv_id, turn, text, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM conversations WHERE role = 'assistant' AND text IS NOT NULL WINDOW w AS (PARTITION BY conv_id, turn ORDER BY text)),
b AS (SELECT conv_id, turn, text, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id, turn ORDER BY text, role)),
t AS (SELECT concat(a.conv_id, '-', a.turn, '-', greatest(a.i, b.i)) AS id, regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+') AS c, regexp_extract_all(lower(a.text), '[\p{L}\p{N}_]+') AS r
  FROM a JOIN b ON b.conv_id = a.conv_id AND b.turn = (SELECT max(p.turn) FROM b p WHERE p.conv_id = a.conv_id AND p.turn < a.turn)
  AND (a.i = b.i OR (a.i = a.n AND b.i > a.n) OR (b.i = b.n AND a.i > b.n)))"""


@query(f"""WITH {_TURNS}, o(n) AS (VALUES (1), (2), (3), (4)),
own AS (SELECT n, id, g, count(*) AS k FROM (SELECT n, id, unnest(list_transform(range(1, len(c) - n + 2), lambda i: array_to_string(c[i:i + n - 1], ' '))) AS g FROM t, o) GROUP BY ALL),
ref AS (SELECT n, id, g, count(*) AS q FROM (SELECT n, id, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS g FROM t, o) GROUP BY ALL),
h AS (SELECT n, sum(least(k, coalesce(q, 0))) AS hit, sum(k) AS total FROM own LEFT JOIN ref USING (n, id, g) GROUP BY n), l AS (SELECT sum(len(c)) AS lc, sum(len(r)) AS lr FROM t)
SELECT n AS "order", round(CASE WHEN lc < lr THEN exp(1 - lr / lc) ELSE 1 END * exp(avg(ln(greatest(hit, 1e-15) / total)) OVER (ORDER BY n)), 6) AS score FROM h, l""")
def bleu_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus BLEU of one to four words over all assistant turns; bleu holds the first two turns only."""
    return metrics.bleu(turn_pairs(spark, sf_dir)).select("order", r6("score").alias("score"))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-score of the longest common subsequence of each pair."""
    return metrics.rouge_l(turn_pairs(spark, sf_dir)).select("id", r6("score").alias("score"))


@query(f"""WITH {_TURNS}, o(n) AS (VALUES (1), (2), (3), (4)),
own AS (SELECT n, id, g, count(*) AS k FROM (SELECT n, id, unnest(list_transform(range(1, len(c) - n + 2), lambda i: array_to_string(c[i:i + n - 1], ' '))) AS g FROM t, o) GROUP BY ALL),
ref AS (SELECT n, id, g, count(*) AS k FROM (SELECT n, id, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS g FROM t, o) GROUP BY ALL),
held AS (SELECT n, g, ln(count(*)) AS df FROM ref GROUP BY n, g), w AS (SELECT ln(count(*)) AS sets FROM t),
wa AS (SELECT id, n, g, k * (sets - coalesce(df, 0)) AS a FROM own LEFT JOIN held USING (n, g), w), wb AS (SELECT id, n, g, k * (sets - df) AS b FROM ref JOIN held USING (n, g), w),
na AS (SELECT id, n, sqrt(sum(a * a)) AS na FROM wa GROUP BY id, n), nb AS (SELECT id, n, sqrt(sum(b * b)) AS nb FROM wb GROUP BY id, n),
d AS (SELECT id, sum(CASE WHEN na > 0 AND nb > 0 THEN d / (na * nb) ELSE d END) / 4 AS s FROM (SELECT id, n, sum(least(a, b) * b) AS d FROM wa JOIN wb USING (id, n, g) GROUP BY id, n) JOIN na USING (id, n) JOIN nb USING (id, n) GROUP BY id)
SELECT id, round(10 * coalesce(s, 0) * exp(-power(greatest(len(c) - 1, 0) - greatest(len(r) - 1, 0), 2) / 72.0::double), 6) AS score FROM t LEFT JOIN d USING (id)""")
def cider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of tf-idf n-grams of each assistant turn with the turn before it."""
    return metrics.cider(turn_pairs(spark, sf_dir)).select("id", r6("score").alias("score"))


@query()
def meteor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments in few chunks of each assistant turn with the turn before it."""
    return metrics.meteor(turn_pairs(spark, sf_dir)).withColumn("score", r6("score"))


@query(f"""WITH {_TURNS}, c AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(c) AS w FROM t) GROUP BY ALL), r AS (SELECT id, w, count(*) AS r FROM (SELECT id, unnest(r) AS w FROM t) GROUP BY ALL),
h AS (SELECT id, sum(least(c, r))::double AS hit FROM c JOIN r USING (id, w) GROUP BY id)
SELECT id, round(coalesce(hit / len(t.c) * hit / len(t.r) / (0.9 * hit / len(t.c) + 0.1 * hit / len(t.r)), 0), 6) AS score FROM t LEFT JOIN h USING (id)""")
def unigram_f_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted harmonic mean of unigram precision and recall of all assistant turns; unigram_f holds the first two turns only."""
    return metrics.unigram_f(turn_pairs(spark, sf_dir)).select("id", r6("score").alias("score"))


@query("""SELECT story_id, rank, pos AS id, translate(label, '_', ' ') AS label, round(score, 6) AS score, round(w, 6) AS w FROM (
  SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY score DESC, pos) AS rank FROM ref_det WHERE score >= 0.05) WHERE rank <= 3""")
def landmark_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best annotations of each image as detections."""
    d = view(spark, sf_dir, "ref_det").select(F.col("story_id").alias("image_id"), "pos", F.col("label").alias("name"), "score", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return stories.landmark_detections(d, 0.05, 3).select(F.col("image_id").alias("story_id"), "rank", "id", "label", r6("score").alias("score"), r6("w").alias("w"))


@query("""SELECT c.story_id, c.pos, round(CASE WHEN c.pos % 4 = 0 THEN 0.1 ELSE r.x END, 6) AS x, round(CASE WHEN c.pos % 4 = 0 THEN 0.21 ELSE r.w END, 6) AS w
FROM cand_det c LEFT JOIN ref_det r ON r.story_id = c.story_id AND r.pos = c.pos + 1 WHERE c.pos % 4 = 0 OR r.pos IS NOT NULL""")
def resolved_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks that borrow the box of another detection, or keep their own if they name none; a name that is not there drops them."""
    ref = view(spark, sf_dir, "ref_det").select(F.col("story_id").alias("image_id"), F.col("pos").cast("string").alias("global_id"), "x", "y", "w", "h")
    use = F.when(F.col("pos") % 4 != 0, (F.col("pos") + 1).cast("string")).alias("use_box_id")
    lm = view(spark, sf_dir, "cand_det").select(F.col("story_id").alias("image_id"), "pos", use, *(F.lit(v).alias(n) for n, v in (("x1", 10), ("y1", 10), ("x2", 30), ("y2", 30))))
    return stories.resolve_boxes(lm, ref).select(F.col("image_id").alias("story_id"), "pos", r6("box.x").alias("x"), r6("box.w").alias("w"))


@query("""SELECT concat('p', l_suppkey % 50) AS entity_id, arg_min(l_returnflag, l_linenumber::bigint * 1000000000 + l_orderkey * 10 + ascii(l_returnflag) % 10) AS name FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1
  HAVING count(*) FILTER (l_returnflag <> 'N') > 0""")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name that each entity is given."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), (F.col("l_suppkey") % 50).cast("string")).alias("entity_id"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("name"), F.col("l_linenumber").alias("image_number"), (F.col("l_orderkey") * 10 + F.ascii("l_returnflag") % 10).alias("pos"))
    return stories.entity_names(rows)


@query("""WITH o AS (SELECT o_custkey AS match_id, o_orderkey AS id, o_orderpriority LIKE '1%' AS thing FROM orders) SELECT id, match_id, members FROM (SELECT *, count(*) OVER (PARTITION BY match_id) AS members FROM o) WHERE members > 1 OR thing""")
def entity_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of matches with several members, or that are things."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("match_id"), F.col("o_orderkey").alias("id"), F.startswith("o_orderpriority", F.lit("1")).alias("is_thing"), F.lit(None).cast("boolean").alias("is_landmark"))
    return stories.entity_ids(o).select("id", "match_id", "members")


@query("""WITH o AS (SELECT o_custkey * 10000 + year(o_orderdate) AS match_id, o_orderkey AS id, o_orderpriority LIKE '1%' AS thing FROM orders) SELECT id, match_id, members FROM (SELECT *, count(*) OVER (PARTITION BY match_id) AS members FROM o) WHERE members > 1 OR thing""")
def year_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_members over all orders; a match is a customer's orders of one year, of which many are alone."""
    match_id = F.col("o_custkey") * 10000 + F.year("o_orderdate")
    o = table(spark, sf_dir, "orders").select(match_id.alias("match_id"), F.col("o_orderkey").alias("id"), F.startswith("o_orderpriority", F.lit("1")).alias("is_thing"), F.lit(None).cast("boolean").alias("is_landmark"))
    return stories.entity_ids(o).select("id", "match_id", "members")


@query("SELECT count(*) AS total, count_if(quality = 1) AS human, count_if(quality <> 1) AS auto FROM labels")
def annotation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.annotation_stats(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("human_annotated")))


@query(f"""WITH {_SAID}, m AS (SELECT pronoun, avg(ungrounded * 100.0::double / total) AS v FROM said GROUP BY pronoun)
SELECT 'first' AS person, round(coalesce(avg(v) FILTER (pronoun IN ('me', 'my', 'we', 'us', 'our')), 0), 6) AS mean FROM m
UNION ALL SELECT 'second', round(coalesce(avg(v) FILTER (pronoun IN ('you', 'your')), 0), 6) FROM m
UNION ALL SELECT 'third', round(coalesce(avg(v) FILTER (pronoun IN ('he', 'she', 'it', 'they', 'him', 'her', 'its', 'their', 'them')), 0), 6) FROM m""")
def pronouns_by_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of ungrounded uses over the pronouns of each grammatical person; "his" is in none."""
    said = statistics.ungrounded_pronouns(tagged(spark, sf_dir)).withColumn("share", F.col("ungrounded") * 100 / F.col("total"))
    return statistics.by_person(statistics.mean_by_key(said, "pronoun", "share"), "mean").select("person", r6("mean").alias("mean"))


# --- sentiment ------------------------------------------------------------------------------------------


def phase_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phases, images and a lexicon of the tagged stories: a phase lists its image and the first one; every word has a valence."""
    t = tagged(spark, sf_dir)
    images = t.select("story_id", F.explode_outer("images").alias("i")).select("story_id", "i.image_number", "i.text")  # no story is without; explode would build them twice to ask
    phases = t.select("story_id", F.posexplode(F.array(*map(F.lit, text.NARRATIVE_PHASES))).alias("place", "narrative_phase"))
    phases = phases.withColumn("images", F.concat((F.col("place") + 1).cast("string"), F.lit(", image 1")))
    sentences = view(spark, sf_dir, "story_line", dealt=False).select("sentence").distinct()  # images are sentences with blanks between them; these repeat
    word = sentences.select(F.explode(names.words(F.lower("sentence"))).alias("word")).distinct()
    return phases, images, word.withColumn("valence", ((F.length("word") * 7 + F.ascii("word")) % 9 - 4).cast("double"))


@query()
def sentiment_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How phases, and characters in them, are spoken of."""
    return sentiment.phase_sentiment(*phase_rows(spark, sf_dir)).withColumn("sentiment", r6("sentiment"))


@query()
def sentiment_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is well and ill spoken of in each phase."""
    d = sentiment.sentiment_split(sentiment.phase_sentiment(*phase_rows(spark, sf_dir)))
    return d.select("place", "narrative_phase", *[r6(c).alias(c) for c in ("overall", "positive", "negative", "positive_share", "negative_share")])
