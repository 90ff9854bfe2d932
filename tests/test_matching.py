"""Matching across frames, faces and mask boxes against plain loops that follow the rules one step at a time."""

from pathlib import Path

import numpy as np
import pytest

from taleframe.operators import masks, matching
from taleframe.plans import queries

DATA = Path("/root/testdata/sf0.001")
SHAPE = "story long, label string, frame int, pos long, clip array<double>, face array<double>"


def plain(rows, least, factor, face_least, need_face=False, single=True):
    """story, label, match, member, pos and (image mean, image deviation, face mean, face deviation) after each admission."""
    out = []
    for story, label in sorted({r[:2] for r in rows}):
        person = label.lower() == "person"
        free = sorted((r for r in rows if r[:2] == (story, label) and not (need_face and person and r[5] is None)), key=lambda r: (r[2], r[3]))
        cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) + 1) / 2
        match = 0
        while free:
            members, state = [free.pop(0)], [0.0, 0.0, None, None]
            found = [(story, label, match, 0, members[0][3], tuple(state))]
            while True:
                for c in free:
                    if c[2] in {m[2] for m in members}:
                        continue
                    images = [cos(c[4], m[4]) for m in members]
                    faces = [float(np.dot(c[5], m[5])) for m in members if person and c[5] is not None and m[5] is not None]
                    if need_face and person and not faces:
                        continue
                    s, low, mean, spread = (faces, face_least, *state[2:]) if faces else (images, least, *state[:2])
                    high = np.percentile(s, 75)
                    if high < low or (spread and spread > 0 and mean - high > factor * spread):
                        continue
                    told = lambda s: [float(np.mean(s)), float(np.std(s)) if len(s) > 1 else 0.0]
                    state = told(images) + (told(faces) if faces else state[2:])
                    members.append(c)
                    free.remove(c)
                    found.append((story, label, match, len(members) - 1, c[3], tuple(state)))
                    break
                else:
                    break
            if single or len(members) > 1:
                out += found
            match += 1
    return [(*r[:5], tuple(None if v is None else round(v, 6) for v in r[5])) for r in sorted(out, key=lambda r: r[:4])]


def collected(df):
    cut = lambda v: None if v is None or v != v else round(v, 6)
    rows = [(r["story"], r["label"], r["match"], r["member"], r["pos"], tuple(map(cut, (r["similarity"], r["spread"], r["face_similarity"], r["face_spread"])))) for r in df.collect()]
    return sorted(rows, key=lambda r: r[:4])


@pytest.fixture(scope="module")
def people():
    rng, rows = np.random.default_rng(6), []
    for s in range(4):
        for label in ("Person", "cup"):
            for k in range(40):
                face = [float(x) for x in rng.normal(size=3)] if rng.random() < 0.6 else None
                rows.append((s, label, int(rng.integers(0, 8)), k, [float(x) for x in rng.normal(size=4)], face))
    return rows


@pytest.mark.parametrize("need_face", [False, True])
@pytest.mark.parametrize("single", [False, True])
def test_entities_equal_a_loop(spark, people, need_face, single):
    df = spark.createDataFrame(people, SHAPE)
    got = collected(matching.match_entities(df, 0.4, 0.3, -0.5, need_face, single))
    assert got == plain(people, 0.4, 0.3, -0.5, need_face, single)


def test_the_last_admission_decides(people):
    held, free = plain(people, 0.4, 0.3, -0.5), plain(people, 0.4, 1e9, -0.5)
    assert [r[:5] for r in held] != [r[:5] for r in free]  # some are refused for their distance alone


def test_one_that_the_spread_refuses(spark):
    # similarities of each with those before: (1.0), (0.9, 0.5), then 0.6 and 0.6 against mean 0.7 and deviation 0.2
    at = lambda *v: [float(x) for x in v]
    rows = [(1, "cup", 0, 0, at(1, 0), None), (1, "cup", 1, 1, at(0.8, 0.6), None), (1, "cup", 2, 2, at(0, 1), None), (1, "cup", 3, 3, at(-0.2, -0.9798), None)]
    loose, strict = (matching.match_entities(spark.createDataFrame(rows, SHAPE), 0.0, f) for f in (9.0, 0.1))
    assert collected(loose) == plain(rows, 0.0, 9.0, 0.4) and collected(strict) == plain(rows, 0.0, 0.1, 0.4)
    assert max(r[2] for r in collected(loose)) == 0 and max(r[2] for r in collected(strict)) == 1


def test_rank_is_by_the_last_state(spark, people):
    m = matching.match_entities(spark.createDataFrame(people, SHAPE), 0.4, 0.3, -0.5)
    groups = {}
    for r in plain(people, 0.4, 0.3, -0.5):
        groups.setdefault(r[:3], []).append(r)
    where = {(r[0], r[1], r[3]): r[2] for r in people}
    best = lambda g: max(g[-1][5][0], g[-1][5][2] or 0.0)
    want = {}
    for story in {k[0] for k in groups}:
        mine = sorted((where[g[0][0], g[0][1], g[0][4]], g[0][4], k[1], k, best(g)) for k, g in groups.items() if k[0] == story)
        for rank, (*_, k, value) in enumerate(sorted(mine, key=lambda r: -r[-1]), 1):
            want[k] = (rank, value)
    got = {(r["story"], r["label"], r["match"]): (r["rank"], r["best"]) for r in matching.rank_matches(m).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-5 for k in got)


def test_queries_over_whole_tables_equal_the_loop(spark):
    rows = [tuple(r) for r in queries.vector_frames(spark, str(DATA)).collect()]
    assert len(rows) == spark.read.parquet(f"{DATA}/embeddings.parquet").where("label is not null").count()
    rule = queries.MATCHING
    got = queries.matched_entities(spark, str(DATA)).collect()
    want = plain(rows, rule["threshold"], rule["factor"], rule["face_threshold"])
    have, due = {(r["story"], r["pos"]): r for r in got}, {(r[0], r[4]): r for r in want}
    assert set(have) == set(due) and all(have[k]["member"] == due[k][3] and abs(have[k]["similarity"] - due[k][5][0]) < 1e-5 for k in have)
    ranked = queries.ranked_matches(spark, str(DATA)).collect()
    alone = plain(rows, rule["threshold"], rule["factor"], rule["face_threshold"], True, False)
    assert sorted((r["story"], r["label"], r["match"]) for r in ranked) == sorted({r[:3] for r in alone})


def test_prefixes_by_kind(spark):
    m = spark.createDataFrame([(1, "person", 0, 0, 0, 0), (1, "dog", 0, 0, 0, 1), (1, "dog", 1, 0, 0, 2), (1, "tower", 0, 0, 1, 0), (1, "sky", 0, 0, 1, 1), (1, "sky", 0, 1, 2, 0)], "story long, label string, match int, member int, frame int, pos long")
    kinds = spark.createDataFrame([(1, 0, 0, True, None), (1, 0, 1, True, None), (1, 0, 2, True, True), (1, 1, 0, False, True), (1, 1, 1, None, None)], "story long, frame int, pos long, is_thing boolean, is_landmark boolean")
    got = {(r["label"], r["match"]): r["entity_id"] for r in matching.entity_prefixes(m, kinds).collect()}
    assert got == {("person", 0): "char1", ("dog", 0): "obj1", ("dog", 1): "obj2", ("tower", 0): "lm1", ("sky", 0): "bg1"}


def faces_in_turn(people, faces, confidence=0.7, least=112.0):
    out, used = [], set()
    for frame, pos, x, y, w, h, mask in sorted(people, key=lambda p: (p[0], p[4] * p[5], p[1])):
        best, choice = float("inf"), None
        for f, face, sure, x1, y1, x2, y2 in sorted(faces):
            cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
            if f != frame or sure < confidence or (f, face) in used or not (x <= cx <= x + w and y <= cy <= y + h) or max(x2 - x1, y2 - y1) < least:
                continue
            if mask is not None:
                i, j = int((cy - y) / h * len(mask)), int((cx - x) / w * len(mask[0]))
                if 0 <= i < len(mask) and 0 <= j < len(mask[0]) and mask[i][j] == 1:
                    choice = face
                break
            far = np.hypot(cx - x - w / 2, cy - y - h / 2) / (np.hypot(x2 - x1, y2 - y1) * sure + 1e-6)
            if far < best:
                best, choice = far, face
        if choice is not None:
            used.add((frame, choice))
            out.append((frame, pos, choice))
    return sorted(out)


def test_faces_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    people, faces = [], []
    for frame in range(40):
        for k in range(5):
            mask = rng.integers(0, 2, size=(3, 2)).tolist() if rng.random() < 0.5 else None
            people.append((frame, k, *map(float, rng.integers(0, 300, 2)), *map(float, rng.integers(300, 600, 2)), mask))
            x, y, side = (float(v) for v in rng.integers(60, 500, 3))
            faces.append((frame, k, round(float(rng.uniform(0.5, 1)), 3), x, y, x + side, y + side / 2))
    p = spark.createDataFrame(people, "frame int, pos long, x double, y double, w double, h double, mask array<array<int>>")
    f = spark.createDataFrame(faces, "frame int, face long, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = sorted(tuple(r) for r in matching.assign_faces(p, f).collect())
    assert got == faces_in_turn(people, faces) and len(got) > 40
    bare = [(*r[:6], None) for r in people]
    assert sorted(tuple(r) for r in matching.assign_faces(p.drop("mask"), f).collect()) == faces_in_turn(bare, faces)


def test_every_face_goes_to_one_person(spark):
    got = queries.assigned_faces(spark, str(DATA)).collect()
    assert got and len({(r["frame"], r["face"]) for r in got}) == len({(r["frame"], r["pos"]) for r in got}) == len(got)


def test_scores_are_counts_of_pixels():
    rng = np.random.default_rng(8)
    for _ in range(30):
        grid = rng.random((25, 30)) < 0.4
        points = np.argwhere(grid)
        if len(points) < 2:
            continue
        corners = np.sort(rng.integers(points.min(0), points.max(0) + 1, size=(3, 2, 2)), axis=1)
        boxes = [[int(v) for v in c.ravel()] for c in corners]
        inside = [grid[b[0] : b[2] + 1, b[1] : b[3] + 1] for b in boxes]
        got = masks.Pixels(points).score(boxes)
        assert np.allclose(got, (sum(i.sum() for i in inside) / len(points), sum((~i).sum() for i in inside) / len(points)))


def test_edges_are_trimmed_and_boxes_move_apart():
    line = np.array([[x, y] for x in range(100) for y in (0, 1)] + [[1000, 0]])
    x1, y1, x2, y2 = masks.trimmed_box(line, 0.05)
    above = sorted(v for v in line[:, 0] if v >= line[:, 0].mean())
    assert (x1, x2) == (sorted(v for v in line[:, 0] if v < line[:, 0].mean())[int(0.05 * sum(line[:, 0] < line[:, 0].mean()))], above[len(above) - 1 - int(len(above) * 0.05)])
    assert x2 < 1000 and masks.trimmed_box(np.array([[1, 1], [2, 2]]), 0.05) is None
    a, b = masks.separated([[0, 0, 10, 10], [8, 0, 18, 10]])
    assert (a, b) == ([0, 0, 9, 10], [9, 0, 18, 10])
    assert masks.separated([[8, 0, 18, 10], [0, 0, 10, 10]]) == [[9, 0, 18, 10], [0, 0, 9, 10]]


def test_boxes_of_masks(spark):
    block = lambda x0, y0, n: [(float(x), float(y)) for x in range(x0, x0 + n) for y in range(y0, y0 + n)]
    shape = {1: block(0, 0, 20), 2: block(0, 0, 20) + block(60, 60, 20), 3: [], 4: [(3.0, 3.0)], 5: block(0, 0, 20) * 2}
    rows = [(i, [{"x": x, "y": y} for x, y in p]) for i, p in shape.items()] + [(6, None)]
    df = spark.createDataFrame(rows, "id long, points array<struct<x:double,y:double>>")
    found = {}
    for r in masks.mask_boxes(df).collect():
        found.setdefault(r["id"], []).append((r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"]))
    assert found[1] == found[5] == [(0.0, 0.0, 19.0, 19.0)] and sorted(found[2]) == [(0.0, 0.0, 19.0, 19.0), (60.0, 60.0, 79.0, 79.0)] and set(found) == {1, 2, 5}
    again = masks.mask_boxes(df.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, masks.mask_boxes(df).collect()))


def test_many_masks_have_the_boxes_of_each_alone(spark):
    rng, size = np.random.default_rng(0), 40
    sets = [np.unique(rng.integers(0, s, (n, 2)), axis=0) for s in (2, 6, 30, 300) for n in (1, 2, 3, 7, size) for _ in range(3)]
    width = max(map(len, sets))
    real = np.arange(width)[None] < np.array([[len(s)] for s in sets])
    p = np.stack([np.concatenate([s, np.repeat(s[:1], width - len(s), 0)]) for s in sets]).astype(float)
    alone = [masks.best_boxes(s.astype(float)) for s in sets]
    assert masks.many_boxes(p, real, 6, 0.9, 0.3, 6, 1) == alone and any(len(b) > 1 for b in alone)
    rows = [(k, [(int(x), int(y)) for x, y in s]) for k, s in enumerate(sets)] + [(98, []), (99, None)]
    got = masks.mask_boxes(spark.createDataFrame(rows, "id long, points array<struct<x:long,y:long>>").coalesce(1)).collect()
    want = [(k, i, b[0], b[1], b[2] - b[0], b[3] - b[1]) for k, bs in enumerate(alone) for i, b in enumerate(bs)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_sums_of_clusters_follow_the_points_that_move(monkeypatch):
    rng = np.random.default_rng(3)
    p = np.stack([np.unique(rng.integers(-9, 60, (300, 2)), axis=0)[:200] for _ in range(5)]).astype(float)
    real = np.ones(p.shape[:2], dtype=bool)
    for k in (1, 2, 6):
        owner, sums = masks._owners(p, real, k, masks._drawn(1, k, 0, real.sum(1)))
        for i in range(len(p)):
            assert (owner[i] == masks._clusters(p[i], k, np.random.default_rng([1, k, 0]))).all()
            assert [[(owner[i] == j).sum(), *p[i][owner[i] == j].sum(0)] for j in range(k)] == sums[:, i].T.tolist()
    starts, owners = [], masks._owners
    monkeypatch.setattr(masks, "_owners", lambda p, real, k, drawn: starts.append(k) or owners(p, real, k, drawn))
    masks.many_boxes(p, real, 3, 2.0, 0.0, 4, 1)
    assert starts == [1] + [2] * 4 + [3] * 4  # one cluster is the same from any start


def test_lines_are_dealt_before_they_are_pixels(spark, tmp_path):
    from taleframe.plans import story_queries

    lines = [(1, 10, 20), (1, 10, 20), (1, 13, 20), (2, 59, 0), (None, 0, 59)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    d = story_queries.area_boxes(spark, str(tmp_path))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    squares = {i: {(p % 60 + k // 6, s % 60 + k % 6) for o, p, s in lines if o == i for k in range(36)} for i, _, _ in lines}
    want = [(i, k, x1, y1, x2 - x1, y2 - y1) for i, s in squares.items() for k, (x1, y1, x2, y2) in enumerate(masks.best_boxes(np.array(sorted(s), dtype=float)))]
    assert sorted(map(tuple, d.collect()), key=str) == sorted(want, key=lambda r: str((*r[:2], *map(float, r[2:]))))
