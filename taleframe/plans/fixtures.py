"""Story-shaped views over the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "part", "embeddings", "labels", "conversations", "documents", "pages", "events")

_POS = """row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                          l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"""

#: Reference detections: boxes that depend on the keys; two of seven labels are people.
REF = f"""SELECT l_orderkey AS story_id, {_POS} AS pos,
  CASE WHEN l_returnflag = 'R' THEN 'person' ELSE concat('thing_', l_linestatus, ' merged') END AS label,
  CAST(l_partkey % 40 AS DOUBLE) / 100 AS x, CAST(l_suppkey % 40 AS DOUBLE) / 100 AS y,
  CAST(30 AS DOUBLE) / 100 + l_quantity / 100 AS w, CAST(30 AS DOUBLE) / 100 + CAST(l_linenumber AS DOUBLE) / 20 AS h,
  l_discount AS score FROM lineitem"""

#: Candidates: four fifths of the references, a little aside.
CAND = f"""SELECT story_id, pos, label, x + CAST(pos % 3 AS DOUBLE) / 20 AS x, y + CAST(pos % 2 AS DOUBLE) / 50 AS y, w, h, score
  FROM ({REF}) r WHERE pos % 5 <> 0"""

#: Entities by frame of a story.
ENTITY = f"""SELECT DISTINCT l_orderkey AS story_id,
  concat(CASE l_returnflag WHEN 'R' THEN 'char' WHEN 'A' THEN 'obj' ELSE 'bg' END, CAST(l_suppkey % 6 AS VARCHAR(9))) AS entity_id,
  1 + (l_linenumber - 1) % 5 AS image_number FROM lineitem"""

#: Frames of films: ids of the form m7_scene_003_000123.
FRAME = """SELECT o_orderkey AS pos, concat('m', CAST(o_custkey % 20 AS VARCHAR(9)), '_scene_', lpad(CAST(o_orderkey % 12 AS VARCHAR(9)), 3, '0'), '_', lpad(CAST(o_orderkey AS VARCHAR(9)), 9, '0')) AS image_id,
  o_orderpriority LIKE '1%' AS has_person FROM orders"""

#: A tagged sentence for each line, images in order: pronouns of every kind, names, some of them outside tags.
STORY = f"""SELECT l_orderkey AS story_id, {_POS} AS pos, 1 + (l_linenumber - 1) % 5 AS image_number,
  concat(CASE l_returnflag WHEN 'R' THEN '<gdo char' WHEN 'A' THEN '<gdo obj' ELSE '<gdl bg' END, CAST(l_suppkey % 6 AS VARCHAR(9)), '>',
         CASE l_partkey % 10 WHEN 0 THEN 'She' WHEN 1 THEN 'he' WHEN 2 THEN 'I' WHEN 3 THEN 'His' WHEN 4 THEN 'them' WHEN 5 THEN 'you' WHEN 6 THEN 'its' WHEN 7 THEN 'our' WHEN 8 THEN 'Mary Stone' ELSE 'the thing' END,
         CASE WHEN l_returnflag IN ('R', 'A') THEN '</gdo>' ELSE '</gdl>' END,
         CASE WHEN l_linenumber % 3 = 0 THEN ' <gda char1>walks on</gda> with her.' WHEN l_suppkey % 7 = 0 THEN ' and Tom waits for him' WHEN l_suppkey % 7 = 1 THEN ' meets Mary' ELSE ' waits.' END) AS sentence FROM lineitem"""

RATINGS = """SELECT doc_id AS item, 0 AS coder, CAST(quality AS DOUBLE) AS value FROM labels
  UNION ALL SELECT doc_id, 1, CAST(toxic AS DOUBLE) FROM labels UNION ALL SELECT doc_id, 2, CAST(doc_id % 3 AS DOUBLE) FROM labels"""

VIEWS = {"ref_det": REF, "cand_det": CAND, "entity_frame": ENTITY, "scene_frame": FRAME, "story_line": STORY, "ratings": RATINGS}


#: Lines of a task: lines of an order meet in one of as many tasks as the table needs, so a task's memory does not grow with it.
LINES = 400_000


def by_order(lines: DataFrame) -> DataFrame:
    """``lines`` dealt by order, once for all that groups by story; the count of rows comes from the files' footers."""
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(max(tasks, -(-lines.count() // LINES)), "l_orderkey")


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = True) -> DataFrame:
    """A view as a DataFrame; only the columns it names are read.  Lines are dealt by order unless nothing is grouped by story."""
    text = VIEWS[name]
    for t in TABLES:
        if t in text:
            rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            (by_order(rows) if t == "lineitem" and dealt else rows).createOrReplaceTempView(t)
    return spark.sql(text.replace("VARCHAR(9)", "STRING"))


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it uses in front; a recursive statement keeps its keyword."""
    used = [n for n in VIEWS if n in sql]
    if not used:
        return sql
    heads = ", ".join(f"{n} AS ({VIEWS[n].replace('VARCHAR(9)', 'VARCHAR')})" for n in used)
    recursive = sql.lstrip().startswith("WITH RECURSIVE")
    body = sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            body = f"{heads}, {body[len(start):]}"
            break
    else:
        body = f"{heads} {body}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}"
