"""What several training-data operators share: shared-folder tables and ASCII word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lists of paths that ``noted`` blocks keep.
_NOTED: list[list[str]] = []
#: Folders that the file system was asked to remove at the end.
_REMOVED_AT_END: set[str] = set()
#: A key that meets more than one in HEAVY of all rows, and more than LIGHT, is dealt to SALTS tasks in ``salted_join``.
HEAVY, LIGHT, SALTS = 1000, 1000, 64
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in what driver and executors share; removed when the driver's JVM ends.

    It lies in spark.checkpoint.dir.  Where a session names none, a temporary folder does for a local master, whose
    tasks run in the driver; a cluster must name a folder that all machines share.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="taleframe-")
        spark.sparkContext.setCheckpointDir(top)
    folder = f"{top}/taleframe-{spark.sparkContext.applicationId}"
    if folder not in _REMOVED_AT_END:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _REMOVED_AT_END.add(folder)
    return folder


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Files of the shuffles of what is written inside the block go once it is there.

    While tasks run, shuffle files stay, so lost ones are made again as ever.  The session's own setting is put back.
    """
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as a Parquet table, and free the files of its shuffles once the table is there."""
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)


def _new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _NOTED:
        paths.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    The lineage ends here: a lost executor costs the tasks that read the table, not the work that made it.
    """
    path = _new_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_in_buckets(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """As ``stage``, in buckets of ``by``: a join on just these columns sends the other table only.

    Writing sends nothing either.  A task writes a file for each bucket that it has rows of, so ``by`` should have few
    values in a task.  The table's name leaves the catalog at once; its files stay as those of ``stage`` do.
    """
    spark, table = df.sparkSession, f"taleframe_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _shuffles_freed(spark):
        df.write.bucketBy(n, *by).option("path", _new_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def salted_join(rows: DataFrame, per_key: DataFrame, on: list[str], n: str, by: str) -> DataFrame:
    """Inner join of ``rows`` with a table of one row a key, whose column ``n`` says how many of ``rows`` have that key.

    Rows of a heavy key are dealt to tasks by the hash of ``by``, so no task gets them all.  Heavy keys are at most HEAVY by
    their definition, so they are broadcast at any size of the tables.  ``per_key`` is read three times: stage it before.
    Keys with a null and empty tables meet nothing.
    """
    least = max((per_key.agg(F.sum(n)).first()[0] or 0) // HEAVY, LIGHT)
    heavy = per_key.where(F.col(n) > least).select(*on, F.lit(SALTS).alias("_salts"))
    dealt = rows.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.pmod(F.hash(by), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    last = F.when(F.col(n) > least, SALTS - 1).otherwise(0)
    each = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return dealt.join(each, [*on, "_salt"]).drop("_salt")


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables that are staged inside the block."""
    paths: list[str] = []
    _NOTED.append(paths)
    try:
        yield paths
    finally:
        _NOTED.remove(paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        path = hadoop(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id's text modulo ``of``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of
