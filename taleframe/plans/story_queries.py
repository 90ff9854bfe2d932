"""More registered queries: detections, materialised stories, checks, statistics and evaluation from text to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleframe.functions import text
from taleframe.operators import chat, detections, evaluate, matching, metrics, statistics, stories, validate
from taleframe.plans.fixtures import by_order, view
from taleframe.plans.queries import _NAMES, _POSSESSIVES, _REFS, _RUN, _SAID, _SUBJECTS, _TAGGED, query, r6, scene_texts, table, tagged
from taleframe.sources import story_files

# --- detections -----------------------------------------------------------------------------------------


@query("SELECT story_id, pos, concat('[', label, '-', pos, ': ', printf('%.2f', x), ',', printf('%.2f', y), ',', printf('%.2f', w), ',', printf('%.2f', h), ']') AS tag FROM ref_det")
def placeholder_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as tags in a text."""
    d = view(spark, sf_dir, "ref_det")
    return d.select("story_id", "pos", text.placeholder_tag(F.col("label"), F.col("pos"), F.lit(None).cast("string"), tuple(F.col(c) for c in "xywh")).alias("tag"))


@query("""SELECT id, label, image_id, min(k) AS first, count(*) OVER () AS n FROM (
  SELECT pos AS id, label, nullif(story_id % 50, 7) AS image_id, story_id * 100 + pos AS k FROM ref_det) GROUP BY id, label, image_id""")
def distinct_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that are one by id, label and image; an image may be null."""
    image = F.col("story_id") % 50
    d = view(spark, sf_dir, "ref_det").select(F.col("pos").alias("id"), "label", F.when(image != 7, image).alias("image_id"), (F.col("story_id") * 100 + F.col("pos")).alias("k"))
    one = detections.distinct_detections(d, "k").select("id", "label", "image_id", F.col("k").alias("first"))
    return one.crossJoin(one.agg(F.count("*").alias("n")))


@query("SELECT story_id, pos, rank FROM (SELECT story_id, pos, row_number() OVER (PARTITION BY story_id ORDER BY w * h DESC, pos) AS rank FROM ref_det) WHERE rank <= 3")
def largest_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.largest_detections(view(spark, sf_dir, "ref_det"), 3).select("story_id", "pos", "rank")


@query("""SELECT story_id, list, pos, row_number() OVER (PARTITION BY story_id ORDER BY score DESC, list, pos) AS rank FROM (
  SELECT story_id, 0 AS list, pos, score FROM ref_det UNION ALL SELECT story_id, 1, pos, score FROM cand_det)""")
def combined_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of detections as one, best score first."""
    keep = ["story_id", "pos", "score"]
    both = detections.combined_detections(view(spark, sf_dir, "ref_det").select(*keep), view(spark, sf_dir, "cand_det").select(*keep))
    return both.select("story_id", "list", "pos", "rank")


@query("""WITH p AS (SELECT a.story_id, a.x AS ax1, a.y AS ay1, a.x + a.w AS ax2, a.y + a.h AS ay2, b.x AS bx1, b.y AS by1, b.x + b.w AS bx2, b.y + b.h AS by2, (a.x + a.w - a.x) + (b.x + b.w - b.x) AS tw, (a.y + a.h - a.y) + (b.y + b.h - b.y) AS th,
    least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ox, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS oy, a.x + a.w - a.x AS aw, a.y + a.h - a.y AS ah, b.x + b.w - b.x AS bw, b.y + b.h - b.y AS bh
  FROM ref_det a JOIN ref_det b ON a.story_id = b.story_id AND a.pos = 1 AND b.pos = 2),
q AS (SELECT *, ox > 0 AND oy > 0 AND ox / tw < oy / th AS sx, ox > 0 AND oy > 0 AND NOT (ox / tw < oy / th) AS sy, ax1 < bx1 AS lx, ay1 < by1 AS ly FROM p),
m AS (SELECT story_id, CASE WHEN sx AND NOT lx THEN ax1 + ox * aw / tw ELSE ax1 END AS ax1, CASE WHEN sx AND lx THEN ax2 - ox * aw / tw ELSE ax2 END AS ax2,
  CASE WHEN sy AND NOT ly THEN ay1 + oy * ah / th ELSE ay1 END AS ay1, CASE WHEN sy AND ly THEN ay2 - oy * ah / th ELSE ay2 END AS ay2,
  CASE WHEN sx AND lx THEN bx1 + ox * bw / tw ELSE bx1 END AS bx1, CASE WHEN sy AND NOT ly THEN by2 - oy * bh / th ELSE by2 END AS by2 FROM q)
SELECT story_id, round(least(ax1, ax2), 9) AS ax1, round(greatest(ax1, ax2), 9) AS ax2, round(least(ay1, ay2), 9) AS ay1, round(greatest(ay1, ay2), 9) AS ay2, round(bx1, 9) AS bx1, round(by2, 9) AS by2 FROM m""")
def separated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two boxes of a story, moved apart."""
    d = view(spark, sf_dir, "ref_det").where("pos <= 2")
    box = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    held = d.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("pos", box.alias("b")))).alias("p")).where("size(p) = 2")
    s = held.select("story_id", detections.separated_boxes(F.transform("p", lambda p: p["b"])).alias("s"))
    return s.select("story_id", *[F.round(F.col("s")[k][c], 9).alias(f"{n}{c[1:]}") for k, n, c in ((0, "ax", "x1"), (0, "ax", "x2"), (0, "ay", "y1"), (0, "ay", "y2"), (1, "bx", "x1"), (1, "by", "y2"))])


@query("""SELECT l_orderkey AS id, min(l_partkey % 100)::double AS x, min(l_suppkey % 100)::double AS y, (max(l_partkey % 100) - min(l_partkey % 100))::double AS w, (max(l_suppkey % 100) - min(l_suppkey % 100))::double AS h FROM lineitem GROUP BY l_orderkey""")
def thing_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tight boxes of segments that are things."""
    point = F.struct((F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 100).alias("y"))
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(point).alias("points")).withColumn("label_id", F.lit(1))
    return detections.segment_detections(s).where("is_thing").select("id", "x", "y", "w", "h")


@query()
def area_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes over clusters of the pixels that an order's lines fill, two squares a line: what has no tight box because it is no thing."""
    # a pixel is one number until its set is made, and only lines are dealt: 36 pixels of a line take long to sort and to send
    corner = ((F.col("l_partkey") % 60 + 64) * 256 + F.col("l_suppkey") % 60 + 64).cast("bigint")
    square = lambda c: F.array(*[c + F.lit(256 * (k // 6) + k % 6) for k in range(36)])
    pixel = lambda p: F.struct((F.shiftright(p, 8) - 64).alias("x"), (p.bitwiseAND(255) - 64).alias("y"))
    s = by_order(table(spark, sf_dir, "lineitem")).groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(corner).alias("corners"))
    filled = F.array_distinct(F.flatten(F.transform("corners", square)))
    s = s.select("id", F.transform(filled, pixel).alias("points"), F.lit(detections.LAST_THING + 1).alias("label_id"))
    return detections.segment_detections(s).where("not is_thing").select("id", "k", "x", "y", "w", "h")


@query("""SELECT story_id, pos, trunc((x + w / 4) * 640)::int AS x1, trunc((y + h) * 480)::int AS y2,
  coalesce(CASE WHEN cx >= 0 AND cx < 3 AND cy >= 0 AND cy < 2 THEN [[1, 0, 1], [0, 1, 1]][cy + 1][cx + 1] = 1 END, false) AS on_mask FROM (
  SELECT *, trunc((x + w / 4 + x + w * 1.2::double) / 2 / 1 * 0 + ((x + w / 4 + (x + w * 1.2::double)) / 2 - x) / w * 3)::int AS cx, trunc(((y + y + h) / 2 - y) / h * 2)::int AS cy FROM ref_det)""")
def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces in pixels, and whether their centres lie on the mask of a box."""
    d = view(spark, sf_dir, "ref_det")
    x, y, w, h = (F.col(c) for c in "xywh")
    face = F.struct((x + w / 4).alias("x1"), y.alias("y1"), (x + w * 1.2).alias("x2"), (y + h).alias("y2"))
    mask = F.array(F.array(*map(F.lit, (1, 0, 1))), F.array(*map(F.lit, (0, 1, 1))))
    px = detections.face_pixel_box(face["x1"], face["y1"], face["x2"], face["y2"], F.lit(640), F.lit(480))
    return d.select("story_id", "pos", px["x1"].alias("x1"), px["y2"].alias("y2"), detections.face_in_mask(face, F.struct("x", "y", "w", "h"), mask).alias("on_mask"))


@query("SELECT DISTINCT label FROM ref_det WHERE label IS NOT NULL")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.categories(view(spark, sf_dir, "ref_det"))


@query("""WITH o AS (SELECT story_id, pos % 3 AS frame, pos FROM ref_det WHERE label <> 'person'), l AS (SELECT story_id, pos % 3 AS frame, pos + 100 AS pos FROM ref_det WHERE label = 'person'),
b AS (SELECT story_id, pos % 3 AS frame, pos + 200 AS pos FROM cand_det)
SELECT * FROM o UNION ALL SELECT * FROM l UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.story_id = b.story_id AND l.frame = b.frame)""")
def merged_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and landmarks of each frame; a frame without landmarks takes others."""
    shape = lambda d, k: d.select("story_id", (F.col("pos") % 3).alias("frame"), (F.col("pos") + k).alias("pos"))
    d = view(spark, sf_dir, "ref_det")
    return stories.merge_detections(shape(d.where("label <> 'person'"), 0), shape(d.where("label = 'person'"), 100), shape(view(spark, sf_dir, "cand_det"), 200))


@query("""SELECT vec_id // 50 AS story, label, k - 1 AS coordinate, count(*) AS members,
  round(CASE WHEN count(*) > 1 THEN (sum(v) + arg_min(v, vec_id)) / (count(*) + 1) ELSE sum(v) END, 6) AS value
FROM (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS k, unnest(embedding)::double AS v FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL""")
def match_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of matches, every coordinate; here the vectors of a label in a story, by id, are one match."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    m = e.select(F.floor(F.col("vec_id") / 50).alias("story"), "label", F.col("label").alias("match"), F.col("vec_id").alias("member"), F.col("embedding").alias("clip"))
    c = matching.match_centroids(m).select("story", "label", F.col("members").cast("long").alias("members"), F.posexplode("centroid").alias("coordinate", "value"))
    return c.select("story", "label", F.col("coordinate").cast("long").alias("coordinate"), "members", r6("value").alias("value"))


# --- stories and samples --------------------------------------------------------------------------------


@query("""SELECT story_id, string_agg(concat('img', pos), ',' ORDER BY pos) AS image_ids, string_agg(label, ',' ORDER BY pos) AS labels, sum((label = 'person')::int)::bigint AS people, sum(640 + pos)::bigint AS widths FROM ref_det GROUP BY story_id""")
def story_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories with their frames as arrays; a frame is a line with one detection."""
    d = view(spark, sf_dir, "ref_det")
    det = F.struct("label", "score", F.lit(0).alias("image_width"), F.lit(0).alias("image_height"))
    frames = d.select("story_id", "pos", F.concat(F.lit("img"), F.col("pos").cast("string")).alias("image_id"), F.col("label").alias("caption"), F.struct((640 + F.col("pos")).cast("int").alias("width"), F.lit(480).alias("height")).alias("image"), F.array(det).alias("detections"))
    s = stories.story_arrays(frames)
    return s.select(
        "story_id", F.array_join("image_ids", ",").alias("image_ids"), F.array_join("captions", ",").alias("labels"), F.size(F.filter("has_person", lambda p: p)).cast("long").alias("people"),
        F.aggregate("detections", F.lit(0).cast("long"), lambda a, x: a + x[0]["image_width"]).alias("widths"),
    )


@query("""SELECT concat(doc_id, '_', k, '.txt') AS name, md5(CASE k WHEN 'cot' THEN 'why' WHEN 'story' THEN coalesce(text, '') ELSE concat('a', chr(10), 'b') END) AS digest FROM documents, (VALUES ('cot'), ('story'), ('metadata')) t(k)
  WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def written_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of samples that are not there yet; labelled documents have all three, others of them one at most."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.lit("why").alias("cot"), F.col("text").alias("story"), F.array(F.lit("a"), F.lit("b")).alias("image_ids"))
    have = table(spark, sf_dir, "labels").select("doc_id").distinct().select(F.explode(F.array(*[F.concat(F.col("doc_id").cast("string"), F.lit(f"_{k}.txt")) for k in ("cot", "story", "metadata")])).alias("name"))
    one = d.select(F.concat(F.col("idx").cast("string"), F.lit("_cot.txt")).alias("name"))
    return story_files.sample_texts(d, have.unionByName(one)).select("name", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""SELECT p_partkey AS id, md5(concat('[IMG]', chr(10), '[DETECTIONS]', chr(10), '[', p_brand, '-', p_size, ': ', printf('%.2f', p_size / 100), ',0.25,0.50,1.00]', chr(10), '[/DETECTIONS]')) AS digest, p_name AS caption FROM part""")
def caption_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions as chat examples; the prompt, chosen by a hash, is left out of the digest."""
    box = F.struct((F.col("p_size") / 100).alias("x"), F.lit(0.25).alias("y"), F.lit(0.5).alias("w"), F.lit(1.0).alias("h"))
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("caption"), F.array(F.struct(F.col("p_brand").alias("label"), F.col("p_size").alias("id"), box.alias("box"))).alias("detections"))
    m = chat.caption_examples(d)
    asked = F.col("messages")[0]["content"]
    return m.select("id", F.md5(F.substr(asked, F.instr(asked, "[IMG]")).cast("binary")).alias("digest"), F.col("messages")[1]["content"].alias("caption"))


# --- statistics and checks ------------------------------------------------------------------------------


@query(f"""WITH {_RUN} SELECT story_id, image_number, count(*) FILTER (entity_id LIKE 'char%')::int AS characters, count(*) FILTER (entity_id NOT LIKE 'char%')::int AS objects, 1 AS settings FROM entity_frame JOIN run USING (story_id, image_number) GROUP BY story_id, image_number""")
def per_image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.per_image_counts(scene_texts(spark, sf_dir).select("story_id", text.parse_scenes(F.col("text")).alias("scenes")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """story_id, frames, cot, story of each story."""
    cot = scene_texts(spark, sf_dir).select("story_id", F.col("n_images").cast("int").alias("frames"), F.col("text").alias("cot"))
    return cot.join(tagged(spark, sf_dir).select("story_id", F.col("text").alias("story")), "story_id")


_STATS = rf"""{_SAID}, {_NAMES}, {_RUN},
e AS (SELECT story_id, image_number, entity_id, entity_id LIKE 'char%' AS c, entity_id LIKE 'bg%' AS b FROM entity_frame JOIN run USING (story_id, image_number)),
sp AS (SELECT story_id, entity_id, c, count(*) AS n FROM e WHERE NOT b GROUP BY ALL),
mf AS (SELECT story_id, avg((n >= 2)::int) FILTER (c) * 100 AS mc, avg((n >= 2)::int) FILTER (NOT c) * 100 AS mo FROM sp GROUP BY story_id),
sh AS (SELECT f.story_id, f.frames, coalesce(count(DISTINCT e.image_number), 0) AS images, count(*) FILTER (c) AS nc, count(*) FILTER (NOT c) AS no FROM (SELECT story_id, count(DISTINCT image_number) AS frames FROM entity_frame GROUP BY story_id) f LEFT JOIN e USING (story_id) GROUP BY ALL),
tg AS (SELECT story_id, len(regexp_extract_all(text, '(?s)<gdo char\d+[^>]*>.*?</gdo>')) AS cr, len(regexp_extract_all(text, '(?s)<gdo obj\d+[^>]*>.*?</gdo>')) AS orf, len(regexp_extract_all(text, '(?s)<gda[^>]*>.*?</gda>')) AS ar, len(regexp_extract_all(text, '(?s)<gdl[^>]*>.*?</gdl>')) AS sr,
  len(list_distinct(regexp_extract_all(text, '<gdo char(\d+)', 1))) AS dc, len(list_filter(regexp_extract_all(text, '(?s)<gdo char\d+[^>]*>(.*?)</gdo>', 1), lambda r: lower(r) IN {_REFS})) AS pr, len(list_filter(regexp_extract_all(text, '(?s)<gdo char\d+[^>]*>(.*?)</gdo>', 1), lambda r: lower(r) IN ('he', 'she', 'they', 'we', 'you'))) AS ps, len(list_filter(regexp_extract_all(text, '(?s)<gdo char\d+[^>]*>(.*?)</gdo>', 1), lambda r: lower(r) IN ('his', 'her', 'their', 'my', 'our', 'your'))) AS pp, len(regexp_extract_all(text, '<gda char\d+')) AS ca,
  len(regexp_extract_all(regexp_replace(text, '<[^>]+>', '', 'g'), '[\p{{L}}\p{{N}}_]+')) AS words FROM tagged),
u AS (SELECT story_id, sum(ungrounded) * 100.0::double / sum(total) AS u, sum(ungrounded) FILTER (pronoun IN {_SUBJECTS}) * 100.0::double / sum(total) FILTER (pronoun IN {_SUBJECTS}) AS us,
  sum(ungrounded) FILTER (pronoun IN {_POSSESSIVES}) * 100.0::double / sum(total) FILTER (pronoun IN {_POSSESSIVES}) AS up FROM said GROUP BY story_id),
nn AS (SELECT story_id, sum(ungrounded) * 100.0::double / sum(total) AS un FROM nouns GROUP BY story_id)"""
_MEANS = {
    "total_stories": "count(*)::double", "avg_frames_per_story": "avg(frames)", "max_frames_per_story": "max(frames)::double", "pct_chars_multi_frame": "avg(mc)", "pct_objs_multi_frame": "avg(mo)",
    "avg_entity_refs": "avg(cr + orf + ar + sr)", "avg_char_refs": "avg(cr)", "avg_obj_refs": "avg(orf)", "avg_setting_refs": "avg(sr)", "avg_action_refs": "avg(ar)",
    "avg_pronoun_pct": "avg(CASE WHEN cr > 0 THEN pr * 100.0::double / cr END)", "avg_subject_pronoun_pct": "avg(CASE WHEN cr > 0 THEN ps * 100.0::double / cr END)", "avg_possessive_pronoun_pct": "avg(CASE WHEN cr > 0 THEN pp * 100.0::double / cr END)",
    "avg_ungrounded_pronouns_pct": "avg(u)", "avg_ungrounded_subject_pronouns_pct": "avg(us)", "avg_ungrounded_possessive_pronouns_pct": "avg(up)", "avg_ungrounded_proper_nouns_pct": "avg(un)",
    "avg_chars_per_image": "sum(nc)::double / sum(images)", "avg_objs_per_image": "sum(no)::double / sum(images)", "avg_settings_per_image": "1",
    "pct_complete_narratives": "avg((story_id % 2 = 0)::int) * 100", "avg_words_per_story": "avg(words)", "avg_distinct_chars": "avg(dc)", "avg_char_actions": "avg(ca)",
}


@query(f"""WITH {_STATS}, a AS (SELECT {", ".join(f"round(coalesce({x}, 0), 6)::double AS {n}" for n, x in _MEANS.items())} FROM sh LEFT JOIN mf USING (story_id) JOIN tg USING (story_id) LEFT JOIN u USING (story_id) LEFT JOIN nn USING (story_id))
SELECT metric, value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT 'ungrounded_' || pronoun, round(avg(ungrounded * 100.0::double / total), 6) FROM said GROUP BY pronoun""")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of a dataset of samples, from their texts."""
    return statistics.dataset_statistics(samples(spark, sf_dir)).withColumn("value", r6("value"))


@query(rf"""WITH {_TAGGED}, {_RUN}, n AS (SELECT story_id, count(DISTINCT image_number) AS n FROM entity_frame GROUP BY story_id), k AS (SELECT story_id, count(*) AS k FROM run GROUP BY story_id),
known AS (SELECT story_id, list(DISTINCT entity_id) AS ids FROM entity_frame JOIN run USING (story_id, image_number) GROUP BY story_id),
g AS (SELECT story_id, list_sort(list_distinct(list_filter(string_split(array_to_string(regexp_extract_all(text, '<gd[oa] (.*?)>', 1), ' '), ' '), lambda x: x <> ''))) AS said FROM tagged),
f AS (SELECT story_id, CASE WHEN coalesce(k, 0) <> n THEN 'image count' WHEN story_id % 2 = 1 THEN 'missing phases: Conclusion' END AS scene_fault,
  list_filter(said, lambda x: NOT list_contains(coalesce(ids, []), x)) AS foreign_ FROM n LEFT JOIN k USING (story_id) LEFT JOIN known USING (story_id) JOIN g USING (story_id))
SELECT story_id AS idx, scene_fault, CASE WHEN len(foreign_) > 0 THEN 'unknown ids: ' || array_to_string(foreign_, ', ') END AS story_fault FROM f WHERE scene_fault IS NOT NULL OR len(foreign_) > 0""")
def invalid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that break a rule of descriptions or of stories."""
    s = samples(spark, sf_dir).select(F.col("story_id").alias("idx"), "cot", "story", F.col("frames").alias("n_images"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return validate.invalid_samples(s)


@query(f"""WITH {_SAID}, m AS (SELECT pronoun, avg(ungrounded * 100.0::double / total) AS v FROM said GROUP BY pronoun)
SELECT pronoun, CASE WHEN pronoun IN {_SUBJECTS} THEN 'subject' WHEN pronoun IN {_POSSESSIVES} THEN 'possessive' ELSE 'object' END AS kind, round(v, 6) AS mean, row_number() OVER (ORDER BY round(v, 9) DESC, pronoun) AS rank FROM m""")
def pronoun_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pronouns by how often no reference grounds them."""
    said = statistics.ungrounded_pronouns(tagged(spark, sf_dir)).withColumn("share", F.col("ungrounded") * 100 / F.col("total"))
    return statistics.pronoun_ranking(said, "share").withColumn("mean", r6("mean"))


# --- evaluation -----------------------------------------------------------------------------------------


def _f1(tp: str, c: str, r: str, name: str) -> str:
    p, q = f"CASE WHEN {c} = 0 THEN 1 ELSE {tp}::double / {c} END", f"CASE WHEN {r} = 0 THEN 1 ELSE {tp}::double / {r} END"
    return f"avg({p}) AS precision{name}, avg({q}) AS recall{name}, avg(CASE WHEN ({p}) + ({q}) = 0 THEN 0 ELSE 2 * ({p}) * ({q}) / (({p}) + ({q})) END) AS f1{name}"


_KEPT = "(image_number + length(entity_id)) % 4 <> 0"


@query(f"""WITH {_TAGGED}, {_RUN}, ce AS (SELECT * FROM entity_frame WHERE {_KEPT} AND story_id % 5 <> 0),
crun AS (SELECT story_id, image_number FROM (SELECT story_id, image_number, row_number() OVER (PARTITION BY story_id ORDER BY image_number) AS k FROM (SELECT DISTINCT story_id, image_number FROM ce)) WHERE k = image_number),
s AS (SELECT DISTINCT story_id FROM ce), r AS (SELECT story_id, entity_id LIKE 'char%' AS c FROM entity_frame JOIN run USING (story_id, image_number)),
d AS (SELECT story_id, entity_id LIKE 'char%' AS c, row_number() OVER (PARTITION BY story_id ORDER BY image_number, entity_id NOT LIKE 'char%', entity_id) AS pos, row_number() OVER (PARTITION BY story_id, entity_id LIKE 'char%' ORDER BY image_number, entity_id) AS k FROM ce JOIN crun USING (story_id, image_number)),
n AS (SELECT story_id, (SELECT count(*) FROM r WHERE r.story_id = s.story_id AND c) AS rc, (SELECT count(*) FROM r WHERE r.story_id = s.story_id AND NOT c) AS ro, (SELECT count(*) FROM d WHERE d.story_id = s.story_id AND c) AS cc, (SELECT count(*) FROM d WHERE d.story_id = s.story_id AND NOT c) AS co FROM s),
t AS (SELECT *, least(rc, cc) AS tc, least(ro, co) AS to_ FROM n),
w AS (SELECT {_f1("(tc + to_)", "(cc + co)", "(rc + ro)", "")}, {_f1("tc", "cc", "rc", "_character")}, {_f1("to_", "co", "ro", "_object")} FROM t),
curve AS (SELECT d.story_id, sum((d.k <= CASE WHEN d.c THEN tc ELSE to_ END)::int) OVER v::double / count(*) OVER v AS p, sum((d.k <= CASE WHEN d.c THEN tc ELSE to_ END)::int) OVER v::double / (rc + ro) AS q FROM d JOIN t USING (story_id) WHERE rc + ro > 0
  WINDOW v AS (PARTITION BY d.story_id ORDER BY d.pos ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT story_id, sum(p) / 11 AS ap FROM (SELECT story_id, i, coalesce(max(CASE WHEN q >= i * 0.1::double THEN p END), 0) AS p FROM curve, range(11) x(i) GROUP BY story_id, i) GROUP BY story_id UNION ALL SELECT story_id, 0 FROM t WHERE rc + ro > 0 AND cc + co = 0),
g AS (SELECT metric, value FROM (UNPIVOT w ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT 'map', avg(ap) FROM ap)
SELECT 'grounding' AS family, metric, round(value, 6) AS score FROM g UNION ALL SELECT 'language', m, 1.0 FROM (VALUES ('bleu_1'), ('bleu_2'), ('bleu_3'), ('bleu_4'), ('rouge_l')) t(m)
UNION ALL SELECT 'language', 'meteor', round(1 - 0.6 * power(count(*)::double / sum(len(regexp_extract_all(regexp_replace(text, '<[^>]+>', '', 'g'), '[\\p{{L}}\\p{{N}}_]+'))), 0.2::double), 6) FROM tagged JOIN s USING (story_id)
UNION ALL SELECT 'missing', 'stories', count(*) FROM (SELECT DISTINCT story_id FROM entity_frame EXCEPT SELECT story_id FROM s)""")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated stories scored against those of the dataset, and how many are missing.

    Here a generated description leaves out some entities; its story is that of the dataset, so language metrics are 1, but for the corpus form of
    alignments, which counts a chunk for each story.
    """
    dims = F.transform(F.sequence(F.lit(1), F.col("frames")), lambda _: F.struct(F.lit(640).alias("width"), F.lit(480).alias("height")))
    real = samples(spark, sf_dir).select("story_id", F.col("cot").alias("chain_of_thought"), "story", dims.alias("images"))
    left = view(spark, sf_dir, "entity_frame").where(f"{_KEPT} and story_id % 5 <> 0")
    made = scene_texts(spark, sf_dir, left).select("story_id", F.col("text").alias("cot")).join(tagged(spark, sf_dir).select("story_id", "text"), "story_id")
    generated = made.select("story_id", F.concat(F.lit("<think>\n"), "cot", F.lit("\n</think>\n"), "text").alias("text"))
    missing = evaluate.missing_stories(real, generated).agg(F.count("*").cast("double").alias("score")).select(F.lit("missing").alias("family"), F.lit("stories").alias("metric"), "score")
    return evaluate.evaluate(real, generated).unionByName(missing).withColumn("score", r6("score"))


