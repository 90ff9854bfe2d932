"""Mix sources to target weights along a training curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taleframe.llm.common import DOCUMENT_COLUMNS, WORD, noted, read, remove, stage

WEIGHTS = (5, 2, 1)
#: Rows (of a few numbers each) that one range of the running sum holds at most, about.
BUCKET_ROWS = 1 << 20
#: (end of the phase as a share of training, weight of a source's demand in it), for sources in turn.
#: The first kind of source is met early, the second evenly, the third late.
SCHEDULES = (((0.5, 1.5), (1.0, 0.5)), ((1.0, 1.0),), ((0.5, 0.5), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _integral(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(start, end, demand before, demand after) of each phase; the whole demand is 1."""
    ends = [0.0, *(e for e, _ in schedule)]
    if ends != sorted(ends) or ends[-1] != 1.0 or any(w < 0 for _, w in schedule):
        raise ValueError("phases must rise to 1.0 and weights must not be negative")
    mass = [(b - a) * w for a, b, (_, w) in zip(ends, ends[1:], schedule, strict=False)]
    if not sum(mass):
        raise ValueError("a schedule needs some demand")
    out, done = [], 0.0
    for a, b, m in zip(ends, ends[1:], mass, strict=False):
        out.append((a, b, done, done + m / sum(mass)))
        done += m / sum(mass)
    return out


def _training_position(demand: Column, turn: Column, schedules) -> Column:
    """Invert the integrated schedule: the share of training at which ``demand`` (0 to 1) is reached."""
    at = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        for a, b, lo, hi in reversed(_integral(schedule)):
            if hi > lo:
                at = F.when((turn == k) & (demand >= lo) & (demand <= hi + 1e-12), a + (demand - lo) * ((b - a) / (hi - lo))).otherwise(at)
    return at


def _before(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the total of each of ``sums`` over the rows that come before in a total order.

    Rows are dealt by ranges; a range adds what the ranges before it hold, one row each, so no window spans the table.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumns({f"_{k}": c for k, c in sums.items()}).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    dealt = stage(dealt, "ranges")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_all_{k}") for k in sums])
    base = totals.select("_part", *[F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_base_{k}") for k in sums])
    here = dealt.withColumns({f"_in_{k}": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums}).join(base, "_part")
    done = here.withColumns({k: F.col(f"_base_{k}") + F.col(f"_in_{k}") for k in sums})
    return done.select(*rows.columns, *sums)


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """Per source: key, turn, rows, source_size, target.

    Targets are min(most * size, level * weight) with the level at which they add up to the whole.  In the
    order in which sources reach their limit, the level that remains once those before are at theirs rises up
    to the first source that stays under its own, and falls after it.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    ranked = _before(sums, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    t = ranked.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * most).cast("double"))
    t = _before(t, [F.col("limit") / F.col("weight"), F.col("rank")], {"full": F.col("limit"), "light": F.col("weight")})
    whole = t.agg((F.sum("source_size") * F.lit(float(share))).alias("total"), F.sum("weight").alias("heavy"))
    t = t.crossJoin(whole)  # one row
    t = t.withColumn("level", (F.col("total") - F.col("full")) / (F.col("heavy") - F.col("light")))
    level = t.agg(F.max(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.col("level"))).alias("at"))  # one row
    t = t.crossJoin(level).withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("at") * F.col("weight"), F.col("limit"))))
    return t.select("source", F.col("rank").cast("int").alias("rank"), "rows", "source_size", "target")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.0,
    most: int = 3,
    schedules=SCHEDULES,
    bucket_rows: int = BUCKET_ROWS,
    row: str | None = None,
) -> DataFrame:
    """Decide how often each document is taken, and where in training.

    Columns: doc_id, source, size (words), source_size, target, copies, taken (size * copies), start (words of
    its source before it), position (share of training at which its first copy is due; null if not taken).

    Every document of a source is taken floor(target / source_size) times; those first in the order of
    md5(doc_id) are taken once more until the target is met to within half a document.  Sources are ordered
    by code point, null last.  A null or blank text has size 0 and changes no target; with a source's size 0
    its documents are not taken.  Repeated ids are told apart by size; rows equal in both are interchangeable,
    unless a column ``row`` numbers them: it comes last in the order and is kept in the result.
    An empty table gives an empty result; other columns are ignored.

    A source's running sum is a sum over ranges of this order plus a window inside one range.  The row's number ends
    the order, so a range splits anywhere: neither a source nor an id that many rows share fills a window.
    """
    number = [row] if row else []
    last = row or "_row"
    numbered = docs if row else docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias(last))
    with noted() as early:
        sized = stage(numbered.select("doc_id", "source", word_count(F.col("text")).alias("size"), last), "mix")
    targets = stage(source_targets(sized, weights, share, most), "mix-targets").withColumn(
        "key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    )
    rows = targets.agg(F.sum("rows")).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // bucket_rows))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    order = ["order", F.col("doc_id").asc_nulls_first(), "size", last]
    d = sized.withColumns({"key": key, "order": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))})
    d = stage(d.repartitionByRange(n, "key", *order).withColumn("bucket", F.spark_partition_id()), "mix-ranges")
    remove(docs.sparkSession, early)
    by_bucket = d.groupBy("key", "bucket").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("offset", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    offsets = offsets.join(targets.select("key", "rank", "source_size", "target"), "key")
    inside = Window.partitionBy("key", "bucket").orderBy(*order)
    d = d.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    d = d.join(offsets, ["key", "bucket"]).withColumn("start", F.col("offset") + F.col("inside"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (F.col("start") + F.col("size") / 2.0 < (rate - whole) * F.col("source_size")).cast("long")
    d = d.withColumn("copies", F.least(whole + extra, F.lit(most)).cast("long"))
    demand = F.least((F.col("start") + F.col("size") / 2.0) / F.col("target"), F.lit(1.0))
    position = F.when((F.col("copies") > 0) & (F.col("target") > 0), _training_position(demand, F.col("rank") % len(schedules), schedules))
    return d.select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), "start", "rank", position.alias("position"), *number,
    )


def mixed_documents(docs: DataFrame, most: int = 3, schedules=SCHEDULES, **options) -> DataFrame:
    """The training stream: each document as often as it is taken, range-sorted by training position.

    Copy r of a document is due after r whole passes over its source.  Every row has a decision of its own,
    whatever its id, so repeated rows and null ids are no exception; a null source is one source; null and blank texts have
    size 0 and are taken as often as their place in the order says; very long texts are moved whole.  Columns are those of
    documents; an empty table gives an empty result.
    """
    rows = stage(docs.select(*DOCUMENT_COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    plan = mix_sources(rows, most=most, schedules=schedules, row="row", **options).where("copies > 0")
    each = rows.join(plan.select("row", F.struct("copies", "start", "source_size", "target", "rank").alias("p")), "row")
    each = each.withColumn("r", F.explode(F.sequence(F.lit(0), (F.col("p.copies") - 1).cast("int"))))
    demand = F.least((F.col("r") * F.col("p.source_size") + F.col("p.start")) / F.when(F.col("p.target") > 0, F.col("p.target")), F.lit(1.0))
    each = each.withColumn("at", _training_position(demand, F.col("p.rank") % len(schedules), schedules))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartitionByRange(n, "at", "doc_id").sortWithinPartitions("at", "doc_id", "row").select(*DOCUMENT_COLUMNS)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each row of documents is taken so that sources meet their targets, and when in training.

    A null text has size 0; null is a source of its own, last in order; sizes of texts of any length are counted whole; ties in
    the order of hashes go by doc_id and size; repeated rows are taken as one another; other columns are ignored; an empty
    table gives an empty result.
    """
    mixed = mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "position", "doc_id").sortWithinPartitions("position", "doc_id")


def _sql_position(demand: str, turn: str) -> str:
    arms = []
    for k, schedule in enumerate(SCHEDULES):
        for a, b, lo, hi in _integral(schedule):
            if hi > lo:
                arms.append(f"WHEN {turn} = {k} AND {demand} >= {lo!r}::double AND {demand} <= {hi!r}::double + 1e-12::double THEN {a!r}::double + ({demand} - {lo!r}::double) * {(b - a) / (hi - lo)!r}::double")
    return "CASE " + " ".join(arms) + " END"


OP10_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint AS size FROM documents),
sums AS (SELECT source, sum(size)::bigint AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sums),
weighed AS (SELECT *, ([5, 2, 1])[rank % 3 + 1]::double AS weight, (source_size * 3)::double AS cap, sum(source_size) OVER ()::double AS total FROM ranked),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM weighed
  WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, rank, source_size,
         least(cap, coalesce(max(CASE WHEN cap > level * weight THEN level END) OVER () * weight, cap)) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
         sum(d.size) OVER (PARTITION BY t.rank ORDER BY md5(coalesce(d.doc_id::varchar, '')), d.doc_id NULLS FIRST, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::bigint - d.size AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::double) ELSE 0.0 END AS rate FROM placed),
copied AS (
  SELECT *, least(floor(rate)::bigint + (start + size / 2.0::double < (rate - floor(rate)) * source_size)::bigint, 3) AS copies FROM rated),
due AS (SELECT *, least((start + size / 2.0::double) / target, 1.0::double) AS demand FROM copied)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies,
       CASE WHEN copies > 0 AND target > 0 THEN {_sql_position("demand", "rank % 3")} END AS position
FROM due
"""
