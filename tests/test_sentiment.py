"""Sentiment against published examples and a plain loop, names by capitals, and the rules of landmarks and descriptions."""

import re
from pathlib import Path
from statistics import mean

import pytest
from pyspark.sql import functions as F

from taleframe.functions import text
from taleframe.functions.valence import Words, compound
from taleframe.operators import names, sentiment, statistics, stories, validate
from taleframe.plans import queries

DATA = Path("/root/testdata/sf0.001")
WORDS = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "great": 3.1, "horrible": -2.5, "bad": -2.5}
#: Figures that the authors of the rules publish.
PUBLISHED = [
    ("VADER is smart, handsome, and funny.", 0.8316), ("VADER is smart, handsome, and funny!", 0.8439), ("VADER is very smart, handsome, and funny.", 0.8545), ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342), ("VADER is VERY SMART, uber handsome, and FRIGGIN FUNNY!!!", 0.9469), ("VADER is not smart, handsome, nor funny.", -0.7424), ("The book was good.", 0.4404),
    ("At least it isn't a horrible book.", 0.431), ("The book was only kind of good.", 0.3832),
]


@pytest.mark.parametrize(("said", "figure"), PUBLISHED)
def test_published_figures(said, figure):
    assert compound(said, WORDS) == figure


def test_contrast_questions_and_bounds():
    assert compound("good but bad", WORDS) < 0 < compound("bad but good", WORDS)
    assert compound("good??", WORDS) == compound("good??", WORDS) > compound("good?", WORDS) and compound("good????", WORDS) == compound("good?????", WORDS)
    assert compound("", WORDS) == compound("nothing known!!!", WORDS) == 0.0 and -1 <= compound("horrible " * 500, WORDS) < -0.99
    assert compound("never so good", WORDS) > compound("good", WORDS) > 0 > compound("wasn't good", WORDS) and compound("the least good", WORDS) < 0


def test_phases_and_characters_equal_a_loop(spark):
    phases, images, lexicon = queries.phase_rows(spark, str(DATA))
    held = {r["word"]: r["valence"] for r in lexicon.collect()}
    said = {}
    for r in images.collect():
        said.setdefault(r["story_id"], {})[r["image_number"]] = r["text"]
    found = {}
    bare = lambda t: re.sub(r"\n{3,}", "\n\n", re.sub(r"<gd[oal][^>]*>|</gd[oal]>", "", re.sub(r"<gdi image\d+>|</gdi>", "", t))).strip()
    for r in phases.collect():
        listed = [int(re.search(r"\d+", part)[0]) for part in r["images"].split(",")]
        whole = "".join(said[r["story_id"]][n] + " " for n in listed if n in said[r["story_id"]])
        if not whole:
            continue
        found.setdefault((r["narrative_phase"], "overall"), []).append(compound(bare(whole), held))
        by = {}
        for m in re.finditer(r"<gdo char(\d+)[^>]*>(.*?)</gdo>", whole, re.DOTALL):
            by.setdefault(m[1], []).append(compound(bare(whole[max(0, m.start() - 100) : min(len(whole), m.start() + 100)]), held))
        for who, scores in by.items():
            found.setdefault((r["narrative_phase"], who), []).append(mean(scores))
    want = {k: round(mean(v), 5) for k, v in found.items()} | {(p, "overall"): 0.0 for p in text.NARRATIVE_PHASES if (p, "overall") not in found}
    rows = queries.sentiment_by_phase(spark, str(DATA)).collect()
    assert {(r["narrative_phase"], r["who"]) for r in rows} == set(want) and len(rows) == len(want) > 25
    assert all(abs(r["sentiment"] - want[r["narrative_phase"], r["who"]]) < 2e-5 for r in rows)
    for r in sentiment.sentiment_split(sentiment.phase_sentiment(phases, images, lexicon)).collect():
        own = [v for (p, who), v in want.items() if p == r["narrative_phase"] and who != "overall" and abs(v - r["overall"]) > 1e-5]
        up, down = [v for v in own if v > 0], [v for v in own if v < 0]
        assert abs(r["positive"] - (mean(up) if up else 0)) < 2e-5 and abs(r["negative"] - (abs(mean(down)) if down else 0)) < 2e-5
        assert abs(r["positive_share"] - len(up) / max(1, len(up) + len(down))) < 1e-9


def test_the_last_row_of_a_phase_counts_and_images_keep_their_order(spark):
    phases = spark.createDataFrame([(1, "Conflict", "1", 0), (1, "Conflict", "Image 2, image 1, image 2", 1), (2, "Conflict", None, 0)], "story_id int, narrative_phase string, images string, place int")
    images = spark.createDataFrame([(1, 1, "one"), (1, 2, "two"), (2, 1, "x")], "story_id int, image_number int, text string")
    assert [r["text"] for r in sentiment.phase_texts(phases, images).collect()] == ["two one two "]
    none = sentiment.phase_sentiment(phases.limit(0), images, spark.createDataFrame([], "word string, valence double"))
    assert {(r["narrative_phase"], r["who"], r["sentiment"], r["stories"]) for r in none.collect()} == {(p, "overall", 0.0, 0) for p in text.NARRATIVE_PHASES}


def test_a_lexicon_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(sentiment, "LEXICON_ROWS", 1)
    with pytest.raises(ValueError, match="at most 1"):
        sentiment.valence(F.lit("x"), spark.createDataFrame([("a", 1.0), ("b", 1.0)], "word string, valence double"))


def test_capitals_tell_names(spark):
    rows = [(1, "<gdo char1>Tom</gdo> sat. Then we saw Tom and Anna. Under it Al lay."), (2, "Anna ran.\nThen she saw then Then Under under <gdo obj1>Rome</gdo>"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "story_id int, text string")
    got = {(r["story_id"], r["word"]): (r["total"], r["grounded"], r["ungrounded"]) for r in names.proper_nouns(df).collect()}
    # "then" has a capital in one of two uses inside sentences, so it counts; "under" too; a word of two letters never does
    assert got == {(1, "tom"): (2, 2, 0), (1, "anna"): (1, 0, 1), (1, "then"): (1, 0, 1), (1, "under"): (1, 0, 1), (2, "anna"): (1, 0, 1), (2, "then"): (2, 0, 2), (2, "under"): (1, 0, 1), (2, "rome"): (1, 0, 1)}


def test_pronouns_keep_the_lists(spark):
    df = spark.createDataFrame([(1, "I saw his dog. i did. <gdo char1>His</gdo> hat and <gdo char2>I</gdo>")], "story_id int, text string")
    assert {(r["pronoun"], r["total"], r["grounded"]) for r in statistics.ungrounded_pronouns(df).collect()} == {("his", 2, 1)}
    means = {r["person"]: r["mean"] for r in statistics.by_person(spark.createDataFrame([("his", 50.0), ("her", 10.0)], "pronoun string, mean double"), "mean").collect()}
    assert means == {"first": 0.0, "second": 0.0, "third": 10.0}


def test_a_landmark_of_an_unknown_box_goes(spark):
    boxes = spark.createDataFrame([(1, "tower-0", 0.1, 0.1, 0.2, 0.2)], "image_id int, global_id string, x double, y double, w double, h double")
    marks = spark.createDataFrame([(1, k, use, 10, 10, 30, 30) for k, use in enumerate(("tower-0", "tower-9", None))], "image_id int, k int, use_box_id string, x1 int, y1 int, x2 int, y2 int")
    assert sorted(r["k"] for r in stories.resolve_boxes(marks, boxes).collect()) == [0, 2]
    assert [r["k"] for r in stories.resolve_boxes(marks, boxes, required=True).collect()] == [0]


def test_faults_come_image_by_image(spark):
    def image(n, char, thing, box, setting=True):
        tables = f"## Image {n}\n### Characters\n| Character ID | Bounding Box |\n|-|-|\n| {char} | {box} |\n\n### Objects\n| Object ID | Bounding Box |\n|-|-|\n| {thing} | 1,2,3,4 |\n\n### Setting\n| Setting Element | Description |\n|-|-|\n"
        return tables + ("| Location | d |\n" if setting else "") + "\n"

    ok, phases = "10,10,20,20", "## Narrative Structure\n| Narrative Phase | Images |\n|-|-|\n" + "".join(f"| {p} | 1 |\n" for p in text.NARRATIVE_PHASES)
    cases = {
        "bounding box": image(1, "char1", "obj1", "none") + image(2, "person", "obj1", ok) + phases,
        "character id": image(1, "char1", "obj1", ok) + image(2, "person", "cup", "none", False) + phases,
        "object id": image(1, "char1", "cup", "none") + image(2, "person", "obj1", ok) + phases,
        "no setting": image(1, "char1", "lm1", "none", False) + image(2, "person", "obj1", ok) + phases,
        "image count": image(1, "person", "cup", "none") + phases,
        "no narrative structure": image(1, "char1", "bg1", ok) + image(2, "char1", "obj1", ok),
        None: image(1, "char1", "bg1", ok) + image(2, "char1", "obj1", ok) + phases,
    }
    df = spark.createDataFrame([(k, t) for k, t in cases.items()], "fault string, text string")
    told = validate.scene_fault(text.parse_scenes(F.col("text")), text.parse_phases(F.col("text")), F.lit(2), F.lit(100), F.lit(100))
    for r in df.select("fault", told.alias("got")).collect():
        assert r["got"] == r["fault"]


def test_a_phase_text_is_judged_once_and_met_by_story(spark):
    images = spark.createDataFrame([(1, 1, "<gdo char1>Tom</gdo> smiles."), (1, 2, "<gdo char1>Tom</gdo> weeps, <gdo char2>Anna</gdo> weeps.")], "story_id int, image_number int, text string")
    phases = spark.createDataFrame([(1, "Conflict", "2", 0), (1, "Conflict", "1, 2", 1), (1, "Conflict", "2", None)], "story_id int, narrative_phase string, images string, place int")
    lexicon = spark.createDataFrame([("smiles", 2.0), ("weeps", -2.0)], "word string, valence double")
    d = sentiment.phase_sentiment(phases, images, lexicon)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert sentiment.sentiment_split(d)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    joined = sentiment.phase_texts(phases.repartition(4, "story_id"), images.repartition(4, "story_id")).hint("merge")
    assert [r["text"] for r in joined.collect()] == ["<gdo char1>Tom</gdo> smiles. <gdo char1>Tom</gdo> weeps, <gdo char2>Anna</gdo> weeps. "]
    got = {(r["narrative_phase"], r["who"]): (r["sentiment"], r["stories"]) for r in d.collect()}
    assert set(got) == {(p, "overall") for p in text.NARRATIVE_PHASES} | {("Conflict", "1"), ("Conflict", "2")}
    assert got["Conflict", "overall"] == (compound("Tom smiles. Tom weeps, Anna weeps.", {"smiles": 2.0, "weeps": -2.0}), 1)


def test_words_are_kept_from_text_to_text(monkeypatch):
    monkeypatch.setattr(Words, "HELD", 3)
    lexicon = {"good": 2.0, "bad": -2.5, "kind": 2.0}
    held = Words(lexicon)
    for t in ("never so good", "GOOD but bad", "a kind of good!", "without doubt good", "not at least good", "good"):
        assert compound(t, held) == compound(t, lexicon) and len(held) <= 3
