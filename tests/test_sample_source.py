from pathlib import Path

import pytest
from pyspark.sql import functions as F

from taleframe.sources import sample_source
from taleframe.sources.sample_source import read_sample_files, write_sample_files

SHAPE = "idx long, cot string, story string, metadata string"
ROWS = [(i, f"why {i}\n", None if i == 3 else f"étoile {i} 😀", f"a\nb{i}") for i in range(25)]


def rows(df):
    return sorted(tuple(r) for r in df.select("idx", "cot", "story", "metadata").collect())


def full(rows_):
    return sorted((i, *(t or "" for t in texts)) for i, *texts in rows_)


@pytest.mark.parametrize("prefix", ["", "file://"])
def test_round_trip(spark, tmp_path, prefix):
    folder = f"{prefix}{tmp_path}/s"
    write_sample_files(spark.createDataFrame([(*r, "x") for r in ROWS], f"{SHAPE}, extra string").repartition(4), folder)
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == sorted(f"{r[0]}_{k}.txt" for r in ROWS for k in sample_source.KINDS)
    got = read_sample_files(spark, folder, 10)
    assert rows(got) == full(ROWS) and got.rdd.getNumPartitions() == 3
    assert (tmp_path / "s" / "3_story.txt").read_bytes() == b""


def test_complete_samples_are_skipped_and_others_made_whole(spark, tmp_path):
    folder = tmp_path / "s"
    write_sample_files(spark.createDataFrame(ROWS[:5], SHAPE), str(folder))
    (folder / "1_story.txt").unlink()
    (folder / "02_cot.txt").write_text("another name")
    (folder / "note.txt").write_text("not a sample")
    assert {r["idx"] for r in read_sample_files(spark, str(folder)).collect()} == {0, 2, 3, 4}
    again = spark.createDataFrame([(i, "new", "new", "new") for i in range(7)], SHAPE)
    write_sample_files(again, str(folder))
    got = {r["idx"]: r["cot"] for r in read_sample_files(spark, str(folder)).collect()}
    assert got == {0: "why 0\n", 1: "new", 2: "why 2\n", 3: "why 3\n", 4: "why 4\n", 5: "new", 6: "new"}
    write_sample_files(again, str(folder), overwrite=True)
    assert {r["cot"] for r in read_sample_files(spark, str(folder)).collect()} == {"new"}


def test_a_failed_job_leaves_no_half_sample(spark, tmp_path):
    folder = tmp_path / "s"
    bad = spark.createDataFrame([*ROWS[:10], (-1, "x", "x", "x")], SHAPE).coalesce(1)
    with pytest.raises(Exception, match="id of 0 or more"):
        write_sample_files(bad, str(folder))
    assert [p for p in folder.rglob("*") if p.is_file()] == [] and read_sample_files(spark, str(folder)).count() == 0
    write_sample_files(spark.createDataFrame(ROWS[:10], SHAPE), str(folder))
    assert rows(read_sample_files(spark, str(folder))) == full(ROWS[:10])


def test_a_task_that_runs_twice_writes_once(spark, tmp_path):
    writer = sample_source._Writer(str(tmp_path / "s"), False)
    batch = spark.createDataFrame(ROWS, SHAPE).toArrow().to_batches()
    first, second = writer.write(iter(batch)), writer.write(iter(batch))
    assert (first.samples, first.skipped, second.samples, second.skipped) == (25, 0, 0, 25)
    writer.commit([first, second])
    assert rows(read_sample_files(spark, str(tmp_path / "s"))) == full(ROWS) and len(list((tmp_path / "s").iterdir())) == 75


def test_all_documents_as_samples(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    samples = docs.select(F.col("doc_id").alias("idx"), F.col("source").alias("cot"), F.col("text").alias("story"), F.col("lang").alias("metadata"))
    write_sample_files(samples, str(tmp_path / "s"))
    assert rows(read_sample_files(spark, str(tmp_path / "s"))) == full([tuple(r) for r in samples.collect()])


def test_edges(spark, tmp_path):
    assert read_sample_files(spark, str(tmp_path / "none")).count() == 0
    write_sample_files(spark.createDataFrame([], SHAPE), str(tmp_path / "empty"))
    assert read_sample_files(spark, str(tmp_path / "empty")).count() == 0
    sample_source.register(spark)
    with pytest.raises(Exception, match="metadata"):
        spark.range(3).selectExpr("id as idx", "'a' as cot", "'b' as story").write.format("samples").mode("append").save(str(Path(tmp_path) / "x"))
