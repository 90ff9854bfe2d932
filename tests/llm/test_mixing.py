import re

import pytest
from pyspark.sql import functions as F

from taleframe.llm.mixing import mix_sources, mixed_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def targets(sizes: dict, most: int = 3) -> dict:
    """Share, cut at the limit, share the excess again, as the words say."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, out, full = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set()
    left = float(total)
    while left > 1e-9 and len(full) < len(sizes):
        open_weight = sum(w for s, w in weights.items() if s not in full)
        for s in sizes:
            if s not in full:
                out[s] += left * weights[s] / open_weight
        left = 0.0
        for s in sizes:
            if out[s] > most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                full.add(s)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(300):
        source = ["a", "b", "c", "d", None, "é"][i % 6] if i % 3 else "a"
        rows.append((i, "w " * (i % 37), "en", source, 2 * (i % 37), "clash"))
    rows += [(300, None, None, "b", None, "x"), (301, "", "en", "zero", 0, "x"), (5, "again and again", "en", "b", 15, "x"), (5, "again and again", "en", "b", 15, "x"), (None, "no id", "en", "c", 5, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_and_taken(docs):
    got = mix_sources(docs).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert (r["position"] is None) == (r["copies"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 37


def test_small_buckets_and_reruns_agree(docs):
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"], str(r["position"]))
    one, two = (sorted(map(key, mix_sources(docs, bucket_rows=b).collect())) for b in (10**6, 3))
    assert one == two


def test_empty_and_blank(spark, docs):
    assert mix_sources(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None, ""), (2, " ", None, "a", 1, "")], SCHEMA)
    assert [(r["size"], r["taken"], r["target"]) for r in mix_sources(blank).collect()] == [(0, 0, 0.0), (0, 0, 0.0)]
    assert mixed_documents(blank).count() == 0


def test_stream_holds_each_copy(docs):
    plain = docs.where("doc_id <> 5")
    want = {r["doc_id"]: r["copies"] for r in mix_sources(plain).where("copies > 0").collect()}
    got = {r["doc_id"]: r["n"] for r in mixed_documents(plain).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_rows_of_one_id_are_decided_each(spark):
    rows = [(i % 4 if i % 5 else None, "w " * (i % 23 + 1), "en", "abc"[i % 3], 0, "") for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r["doc_id"], r["source"])
    want, got = {}, {}
    for r in mix_sources(docs).collect():
        want[key(r)] = want.get(key(r), 0) + r["taken"]
    for r in mixed_documents(docs).collect():
        got[key(r)] = got.get(key(r), 0) + len(r["text"].split())
    assert got == {k: n for k, n in want.items() if n}


def test_very_long_texts_and_one_source(spark):
    rows = [(i, "word " * (200_000 if i == 3 else 50), None, "s" if i < 8 else None, 0, "clash") for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in mix_sources(docs).collect()}
    assert got[3]["size"] == 200_000 and all(r["copies"] <= 3 for r in got.values())
    assert mixed_documents(docs).count() == sum(r["copies"] for r in got.values())


def test_rows_under_one_id_fill_no_range_and_meet_the_target(spark):
    docs = spark.createDataFrame([(7 if i % 3 else None, "w " * (1 + i % 5), "en", "a" if i % 4 else "b", 0) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long")
    got = mix_sources(docs, bucket_rows=50).collect()
    starts = {}
    for r in got:
        starts.setdefault(r["source"], []).append((r["start"], r["size"]))
    for spans in starts.values():  # running sums are gapless over all ranges
        at = 0
        for start, size in sorted(spans):
            assert start == at
            at += size
    taken = {s: sum(r["taken"] for r in got if r["source"] == s) for s in starts}
    assert all(abs(taken[r["source"]] - r["target"]) <= 5 for r in got)
