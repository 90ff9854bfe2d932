"""Rows that are dealt by story are not dealt again, and words are found once."""

from __future__ import annotations

from taleframe.operators import metrics, names, statistics


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entities_are_counted_without_an_expansion(spark):
    rows = [(1, "char1", 1), (1, "char1", 2), (1, "obj1", 1), (1, None, 1), (2, "bg1", 1)]
    frames = spark.createDataFrame(rows, "story_id int, entity_id string, image_number int")
    assert "Expand" not in plan_of(statistics.unique_entities(frames))
    got = {r["story_id"]: tuple(r)[1:] for r in statistics.unique_entities(frames).collect()}
    assert got == {1: (1, 1, 0, 0), 2: (0, 0, 1, 0)}
    tags = statistics.tag_statistics(spark.createDataFrame([(1, "x")], "story_id int, text string"))
    d = statistics.final_statistics(tags, frames)
    assert plan_of(d).count("Expand") == 1  # that of unpivot
    told = {r["metric"]: r["value"] for r in d.collect()}
    assert told["avg_unique_characters"] == 0.5 and abs(told["avg_multi_frame_share"] - 100 / 6) < 1e-9


def test_phases_and_images_meet_by_story(spark):
    images = spark.createDataFrame([(1, 1, "one two"), (1, 2, "three")], "story_id int, image_number int, text string")
    phases = spark.createDataFrame([(1, "Conflict", "2, 1, 2"), (1, "Conflict", "1"), (1, "Conclusion", None), (1, "Development", "9")], "story_id int, narrative_phase string, images string")
    d = statistics.tag_density_by_phase(phases, images)
    assert not [x for x in plan_of(d).splitlines() if "Exchange hashpartitioning" in x and "image_number" in x]
    assert {r["narrative_phase"]: r["words"] for r in d.collect() if r["words"]} == {"Conflict": 5}


def test_words_are_found_once(spark):
    stories = spark.createDataFrame([(1, "We saw Tom."), (2, None), (3, "")], "story_id int, text string")
    plan = names.capital_shares(stories)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert {r["word"]: r["uses"] for r in names.capital_shares(stories).collect()} == {"saw": 1, "tom": 1}


def test_average_precision_deals_no_pair_again(spark):
    rows = [(1, 1, "person", 0.0, 0.0, 1.0, 1.0, 0.9), (1, 2, "cup", 0.0, 0.0, 1.0, 1.0, 0.8), (2, 1, None, 0.0, 0.0, 1.0, 1.0, 0.7)]
    d = spark.createDataFrame(rows, "story_id long, pos long, label string, x double, y double, w double, h double, score double").repartition(3, "story_id")
    out = metrics.average_precision(d, d)
    dealt = [x for x in plan_of(out).splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not [x for x in dealt if "person" in x or "pos" in x]
    assert {r["story_id"]: r["ap"] for r in out.collect()} == {1: 1.0, 2: 0.0}
