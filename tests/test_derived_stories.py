import re

import pytest

from taleframe.operators import stories

SHAPE = "id string, pos long, image struct<width:int,height:int>, caption string, human_annotated boolean, detections array<struct<label:string,image_width:int,image_height:int>>"


def plain(rows, least):
    films = {}
    for id_, pos, _, _, human, dets in rows:
        if not human:
            m = re.match(r"(.+?)_scene_?(\d+)", id_)
            films.setdefault(m[1], {}).setdefault(m[2], []).append((id_, pos, any(d[0].lower() == "person" for d in dets)))
    out = {}
    for film in sorted(films):
        held, k = [], 0
        for scene in sorted(films[film]):
            held += sorted(films[film][scene])
            if len(held) >= least and any(p for *_, p in held):
                out[f"{film}-{k}"] = [i for i, *_ in held]
                held, k = [], k + 1
    people = [i for i, _, p in sorted((f for s in films.values() for x in s.values() for f in x), key=lambda f: f[1]) if p]
    return out or {str(k): people[k * least : k * least + least] for k in range(len(people) // least)}


def fixture(n, people=3):
    dets = lambda k: [("Person" if k % people == 0 else "cup", 0, 0)] if k % 7 else []
    return [(f"m{k % 4}_scene_{k % 9:03d}_{k:05d}", k, (640 + k, 480), f"caption {k}", k % 11 == 0, dets(k)) for k in range(n)]


@pytest.mark.parametrize(("n", "people", "least"), [(200, 3, 5), (200, 3, 17), (24, 2, 7)])  # the last gives no story and falls back
def test_equals_a_loop(spark, n, people, least):
    rows = fixture(n, people)
    got = {r["story_id"]: r for r in stories.derived_stories(spark.createDataFrame(rows, SHAPE).repartition(3), least).collect()}
    want = plain(rows, least)
    assert {k: r["image_ids"] for k, r in got.items()} == want and want
    by = {r[0]: r for r in rows}
    for r in got.values():
        assert [c for c in r["captions"]] == [by[i][3] for i in r["image_ids"]] and [i["width"] for i in r["images"]] == [by[i][2][0] for i in r["image_ids"]]
        assert all(d["image_width"] == by[i][2][0] for i, ds in zip(r["image_ids"], r["detections"], strict=True) for d in ds)


def test_images_are_read_once_after_packing(spark, tmp_path):
    spark.createDataFrame(fixture(300), SHAPE).write.parquet(str(tmp_path / "c"))
    plan = stories.derived_stories(spark.read.parquet(str(tmp_path / "c")))._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"ReadSchema: (\S+)", plan)
    assert len(scans) >= 2 and sum("image:struct" in s or "caption:string" in s for s in scans) == 1
