import numpy as np
import pytest

from taleframe.llm import near_vectors as nv


def brute(rows, cosine):
    unit = {}
    for k, (_, label, e) in enumerate(rows):
        if label is None or not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        v = np.array(e, dtype=float)
        v = v / np.abs(v).max()
        unit[k] = (label, v / np.linalg.norm(v))
    link = {k: [j for j in unit if j != k and unit[j][0] == unit[k][0] and len(unit[j][1]) == len(unit[k][1]) and unit[j][1] @ unit[k][1] >= cosine] for k in unit}
    out = []
    for k, (i, *_) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in link.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((str(i), len(link.get(k, [])), min(ids, default=None), i == min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell", [4096, 5])
def test_equals_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(nv, "CELL_ROWS", cell)
    rng = np.random.default_rng(3)
    rows, hot = [], rng.normal(size=16)
    for i in range(150):
        label = int(i % 3) if i % 10 else None
        e = rng.normal(size=16) if i % 2 else hot + rng.normal(0, 0.25, 16)
        rows.append((int(rng.permutation(10000)[0]) * 1000 + i, label, [float(np.float32(x)) for x in e]))
    rows += [(5, 1, rows[1][2]), (6, 1, rows[1][2]), (6, 1, rows[1][2]), (None, 1, rows[1][2]), (7, 1, [2 * x for x in rows[1][2]]), (8, 1, None), (9, 1, []), (10, 1, [0.0] * 16), (11, 1, [float("nan")] + [1.0] * 15), (12, 1, [None] + [1.0] * 15), (13, 1, [float("inf")] * 16), (14, 1, [1.0, 2.0]), (15, 1, [2.0, 4.0]), (16, 2, [3.0]), (17, 2, [1.0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, label int, embedding array<double>, component string")
    got = sorted(((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in nv.near_vectors(df).collect()), key=str)
    assert got == brute(rows, 0.93)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert nv.near_vectors(df).count() == 0
