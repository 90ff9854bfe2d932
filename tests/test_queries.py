import sys

import duckdb
import pytest
from conftest import DATA, ROOT

from taleframe.plans import queries
from taleframe.plans import story_queries  # noqa: F401 (registers its queries)

sys.path.insert(0, str(ROOT / "tools"))
from compare import TABLES, rows  # noqa: E402

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", queries.ORACLE)
def test_equals_sql(spark, db, name):
    df = queries.QUERIES[name](spark, str(DATA))
    rel = db.sql(queries.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(rel.columns), rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0


def test_stories_of_vectors_grow_in_number(spark):
    assert all(r["story"] == r["pos"] // 50 for r in queries.matched_entities(spark, str(DATA)).collect())


def test_every_assistant_turn_is_scored(spark, db, tmp_path):
    want = db.sql("select count(*) from conversations a where role = 'assistant' and exists (select 1 from conversations b where b.conv_id = a.conv_id and b.turn < a.turn)").fetchall()[0][0]
    for name in ("rouge_l", "cider", "meteor", "unigram_f_turns"):
        assert queries.QUERIES[name](spark, str(DATA)).count() == want
    talk = [(1, 0, "system", "s"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "x"), (1, 4, "user", "u"), (1, 5, "assistant", "z"), (1, 5, "assistant", "z"), (1, 5, "assistant", "y"), (2, 0, "assistant", "first")]
    talk = [(*r[:3], f"{r[3]} one two three") for r in talk]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r["id"], r["candidate"].split()[0], r["reference"].split()[0]) for r in queries.turn_pairs(spark, str(tmp_path)).collect())
    assert got == [("1-3-1", "a", "x"), ("1-3-2", "b", "x"), ("1-5-1", "u", "y"), ("1-5-2", "u", "z"), ("1-5-3", "u", "z")]
    own = duckdb.connect()
    own.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for name in ("bleu_turns", "cider", "unigram_f_turns"):
        df, rel = queries.QUERIES[name](spark, str(tmp_path)), own.sql(queries.ORACLE[name])
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(rel.columns), rel.fetchall())


def test_scenes_are_counted_without_their_images(spark):
    for name in ("movie_scenes", "packed_stories"):
        plan = queries.QUERIES[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(struct(image_id" not in plan and "collect_list(named_struct(image_id" not in plan
        assert plan.count("collect_list") == (name == "packed_stories")


def test_matches_and_samples_are_whole(spark, db, tmp_path):
    alone = {r["id"] for r in queries.year_members(spark, str(DATA)).where("members = 1").collect()}
    things = "select o_orderkey from orders where o_orderpriority like '1%' and (o_custkey, year(o_orderdate)) in (select (o_custkey, year(o_orderdate)) from orders group by o_custkey, year(o_orderdate) having count(*) = 1)"
    assert alone and alone == {r[0] for r in db.sql(things).fetchall()}
    assert queries.year_members(spark, str(DATA)).count() < db.sql("select o_orderkey from orders").count("*").fetchall()[0][0]
    docs = [(3, "a\nb"), (5, "c"), (8, None), (9, "  ")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, queries.complete_samples(spark, str(tmp_path)).collect())) == [(3, 2), (5, 1)]
    assert {r["story_id"] for r in queries.mentioned_entities(spark, str(DATA)).collect()} == {r[0] for r in db.sql("select distinct l_orderkey from lineitem").fetchall()}


@pytest.mark.parametrize("name", ["scene_round_trip", "phase_round_trip", "scene_faults", "per_image_counts", "reading_order_ids", "survival_curve"])
def test_lines_of_an_order_are_dealt_once(spark, name):
    plan = queries.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "story_id" in line or "REPARTITION_BY_NUM" in line]
    assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)


def test_more_lines_are_dealt_to_more_tasks(spark, monkeypatch):
    from taleframe.plans import fixtures

    assert fixtures.view(spark, str(DATA), "ref_det").rdd.getNumPartitions() == 4
    monkeypatch.setattr(fixtures, "LINES", 500)
    lines = spark.read.parquet(str(DATA / "lineitem.parquet")).count()
    assert fixtures.view(spark, str(DATA), "ref_det").rdd.getNumPartitions() == -(-lines // 500)
