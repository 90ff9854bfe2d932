"""Readers, writers and small functions that no registered query reaches."""

import json

import pytest
from pyspark.sql import functions as F

from taleframe.functions import geometry, text
from taleframe.operators import evaluate, matching, statistics
from taleframe.sources import story_files


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "gen").mkdir()
    (tmp_path / "gen" / "s1.txt").write_text(" \n A story.\n ")
    (tmp_path / "gen" / "note.md").write_text("no")
    assert [(r["story_id"], r["text"]) for r in story_files.generated_stories(spark, str(tmp_path / "gen")).collect()] == [("s1", "A story.")]
    (tmp_path / "img").mkdir()
    for name in ("b.png", "a.JPG", "c.gif", "d.txt"):
        (tmp_path / "img" / name).write_bytes(name.encode())
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.select("path").collect())
    assert names(story_files.read_images(spark, str(tmp_path / "img"))) == ["a.JPG", "b.png", "c.gif"]
    assert names(story_files.read_images(spark, str(tmp_path / "img"), 2)) == ["a.JPG", "b.png"]
    metrics = spark.createDataFrame([("f1", 0.5), ("map", 0.25)], "metric string, score double")
    story_files.write_metrics(metrics, str(tmp_path / "m"), hidden=("map",))
    held = [json.loads(line) for f in (tmp_path / "m").glob("part-*.json") for line in f.read_text().splitlines()]
    assert held == [{"metric": "f1", "score": 0.5}]
    spark.createDataFrame([(1, True), (2, False)], "id int, human_annotated boolean").write.parquet(str(tmp_path / "captions"))
    ids = lambda kind: sorted(r["id"] for r in story_files.read_captions(spark, str(tmp_path / "captions"), kind).collect())
    assert (ids("all"), ids("human"), ids("auto")) == ([1, 2], [1], [2])
    with pytest.raises(ValueError):
        ids("none")
    samples = spark.createDataFrame([(1, "c", "s", ["x", "y"]), (2, "c2", None, [])], "idx long, cot string, story string, image_ids array<string>")
    back = story_files.complete_samples(story_files.sample_parts(story_files.sample_texts(samples)))
    assert sorted((r["idx"], r["cot"], r["story"], r["image_ids"]) for r in back.collect()) == [(1, "c", "s", ["x", "y"]), (2, "c2", "", [""])]


def test_rows_of_stories(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "story_id string, pos int, story string")
    assert story_files.by_story_id(rows, "a").first()["story"] == "new" and story_files.by_story_id(rows, "z").count() == 0
    whole = spark.createDataFrame([("a", ["p", "q"], 2, "c", "s", "extra")], "story_id string, images array<string>, frame_count int, chain_of_thought string, story string, extra string")
    one = story_files.examples(whole, 1)
    assert one.columns == ["story_id", "images", "frame_count", "chain_of_thought", "story"] and one.first()["images"] == ["p"]


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(text.readable_label(F.lit("wall-brick"))) == "Wall Brick"
    points = F.array(*[F.lit(float(x)) for x in (5, 1, 9, 3, 7)])
    assert get(geometry.trimmed_edge(points, 0.2, True)) == 3.0 and get(geometry.trimmed_edge(points, 0.2, False)) == 7.0
    assert get(geometry.trimmed_edge(F.array(F.lit(1.0)), 0.2, True)) is None
    d = spark.createDataFrame([(1, 0.5, 0.3), (2, 0.1, 0.3), (3, 0.9, 0.0)], "id int, x double, y double")
    assert [r["id"] for r in d.orderBy(*geometry.legacy_order(F.col("x"), F.col("y"))).collect()] == [3, 2, 1]
    k = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    assert [(r["k"], r["mean"]) for r in statistics.mean_by_key(k, "k", "v").collect()] == [("a", 2.0), ("b", 0.0)]
    assert get(evaluate.image_size(F.array(*map(F.lit, (3, 480, 640))))) == (640, 480)


def test_centroids_and_faces(spark):
    rows = [(1, "p", 0, 0, [1.0, 0.0], [1.0]), (1, "p", 0, 1, [0.0, 1.0], None), (1, "p", 0, 2, [0.0, 1.0], [3.0]), (1, "p", 1, 0, [4.0, 4.0], None)]
    m = spark.createDataFrame(rows, "story int, label string, match int, member int, clip array<double>, face array<double>")
    got = {r["match"]: r for r in matching.match_centroids(m).collect()}
    mean = [1.0, 0.0]
    for n, v in ((2, [0.0, 1.0]), (3, [0.0, 1.0])):
        mean = [(a * n + b) / (n + 1) for a, b in zip(mean, v, strict=True)]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got[0]["centroid"], mean, strict=True)) and got[0]["faces"] == [2.0] and got[0]["with_face"] == 2
    assert got[1]["centroid"] == [4.0, 4.0] and got[1]["with_face"] == 0


def test_descriptions_without_their_images(spark):
    scene = lambda n: "".join(f"## Image {i}\n### Characters\n| Character ID | Bounding Box |\n|-|-|\n| char1 | 0,0,10,10 |\n| char2 | none |\n### Objects\n| Object ID | Description | Bounding Box |\n|-|-|-|\n| obj1 | Red cup | 1,2,3,4 |\n| obj2 |  | 1,2,3,4 |\n" for i in range(1, n + 1))
    images = [(100, 50)]
    df = spark.createDataFrame([("a", scene(1), images), ("b", scene(2), images), ("c", "nothing", images)], "story_id string, text string, images array<struct<width:int,height:int>>")
    got = sorted((r["story_id"], r["pos"], r["label"], round(r["w"], 9)) for r in evaluate.description_detections(df).collect())
    assert got == [("a", 1, "person", 0.1), ("a", 2, "red", 0.02), ("a", 3, "object", 0.02)]


def test_a_detection_is_read_once(spark):
    d = spark.createDataFrame([('{"id": 1, "label": "a_b", "box": {"x": 0.5}}',), ('{"id": 2}',), (None,)], "c string").repartition(2)
    back = d.select(story_files.detection_from_json(F.col("c")).alias("d")).select("d.label", "d.score", "d.image_width", "d.box.x")
    assert back._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted(map(tuple, back.collect()), key=str) == [("a-b", 0.0, 0, 0.5), (None,) * 4, (None,) * 4]


def test_boxes_of_an_evaluation_are_matched_once(spark, monkeypatch):
    from taleframe.operators import metrics
    from taleframe.plans import story_queries

    calls, match = [], metrics.match_detections
    monkeypatch.setattr(metrics, "match_detections", lambda *a, **k: calls.append(a) or match(*a, **k))
    story_queries.evaluation(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_the_first_thought_is_found_without_a_search_by_pattern(spark):
    told = ["a</think> b <think>\n c <i>\n\nd </think>e<think>f</think>", "<think>a", "a</think>", "<think></think>b", "", None, "<think> <think> x</think>"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, t string").select("i", text.reasoning_text(F.col("t")).alias("r"))
    assert "regexp" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert [r["r"] for r in d.orderBy("i").collect()] == ["c <i>\n\nd", "", "", "", "", None, "<think> x"]
