"""How filters on documents interact: what each removes, repeats and loses in every order of application."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleframe.llm.common import read

#: Bit k of a document's mask is set if it fails the k-th filter.
FILTERS = "ABCDE"
SYMBOLS = r"[#$%&*|]"
BATCH_BYTES = 1 << 22
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, word, n from row and text.  A batch holds whole texts, so its groups are whole and need no shuffle."""
    for whole in batches:
        held = np.cumsum(pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.r_[0, np.searchsorted(held, np.arange(BATCH_BYTES, held[-1], BATCH_BYTES)) + 1, len(whole)]) if len(whole) else []
        for first, end in pairwise(cuts):
            b = whole.slice(first, end - first)
            words = pc.ascii_split_whitespace(b.column("text"))
            each = pa.table([b.column("row").take(pc.list_parent_indices(words)), pc.list_flatten(words)], ["row", "word"])
            each = each.filter(pc.not_equal(each["word"], ""))  # what lies before and after the outer spaces
            yield from each.group_by(["row", "word"]).aggregate([([], "count_all")]).rename_columns(["row", "word", "n"]).to_batches()


def word_counts(rows: DataFrame) -> DataFrame:
    """row, words, distinct: of every row with a word, by one row a word, one a row's distinct word, one a row.

    ``row`` must be unique and text not null.  Words are exploded and grouped by row and word where their text is read, some
    BATCH_BYTES of text at once, or one text where it is longer; only counts by row are sent on.
    """
    words = rows.select("row", "text").mapInArrow(_words, "row long, word string, n long")
    return words.groupBy("row").agg(F.sum("n").alias("words"), F.count("*").alias("distinct"))


def failing(docs: DataFrame) -> DataFrame:
    """row, doc_id, part and mask (int, bit k for the k-th filter) of every row.

    A, B, C and D look at a row's own text (null: empty), E at all texts: the smallest doc_id of each text is looked up by
    text and id together, so a hot text is spread over its ids.  A null doc_id is neither smaller nor greater than another.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"),
    )
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    flags = rows.select(
        "row", "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        (100 * capitals > 2 * F.length("text")).alias("c"), F.rlike("text", F.lit(SYMBOLS)).alias("d"),
    )
    first = flags.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flags = flags.join(first, ["digest", "doc_id"], "left").withColumn("e", F.col("first").isNull() & F.col("doc_id").isNotNull())
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct", F.lit(0))
    fails = [words < 200, 100 * distinct < 50 * words, F.col("c"), F.col("d"), F.col("e")]
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return flags.join(word_counts(rows), "row", "left").select("row", "doc_id", "part", mask.alias("mask"))


def with_labels(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask, n with good and toxic; an id with several labels is good, or toxic, if one of them says so.

    Repeated rows, and rows of a null id, are counted (``n``) before they meet labels, so no id is hot; a null id has no label.
    """
    failed = failed.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    each = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    no = F.lit(False)
    return failed.join(each, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})


def mask_counts(labelled: DataFrame) -> DataFrame:
    """One row a part: n_0 … n_31, good_0 … good_31 and toxic_0 … toxic_31, the documents of each mask."""
    small = labelled.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    only = lambda what, m: F.coalesce(F.sum(F.when(what & (F.col("mask") == m), F.col("n"))), F.lit(0))
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    return small.groupBy("part").agg(*[only(what, m).alias(f"{kind}_{m}") for kind, what in kinds.items() for m in range(1 << len(FILTERS))])


def audit(counts: DataFrame) -> DataFrame:
    """Every part with every order of filters and every step of it, from counts by mask alone."""
    masks = range(1 << len(FILTERS))
    tables = {kind: F.array(*[F.struct(F.lit(m).alias("mask"), F.col(f"{kind}_{m}").alias("n")) for m in masks]).alias(kind) for kind in ("n", "good", "toxic")}
    steps = []
    for order in ORDERS:
        seen = 0
        for k, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            steps.append({"filter_order": order, "step": k, "bit": bit, "before": seen})
            seen |= bit
    every = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")  # one constant
    each = counts.select("part", *tables.values()).withColumn("s", F.explode(every))
    bit, before = F.col("s.bit"), F.col("s.before")
    total = lambda kind, test: F.aggregate(F.filter(kind, lambda x: test(x["mask"])), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    here = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)
    orders = F.filter("n", lambda x: x["mask"].bitwiseAND(bit) != 0)
    shapley = F.aggregate(orders, F.lit(0).cast("long"), lambda a, x: a + x["n"] * (F.lit(len(ORDERS)) / F.bit_count(x["mask"])).cast("long"))
    return each.select(
        "part",
        "s.filter_order",
        "s.step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the five filters for every part, order of application and step.

    Null texts are empty (they fail A, and E if a smaller id has no text either); null sources and empty ones are the part of
    empty name; a null doc_id fails E never and has no label; repeated rows count as often as they stand, and rows of the
    smallest id of a text pass E, all of them; long texts are read whole; other columns are ignored; an empty table gives
    an empty result.
    """
    failed = failing(read(spark, sf_dir, "documents"))
    return audit(mask_counts(with_labels(failed, read(spark, sf_dir, "labels"))))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM docs),
counted AS (SELECT row, count(*) AS words, count(DISTINCT word) AS kinds FROM words GROUP BY row),
firsts AS (SELECT text, min(doc_id) AS least FROM docs GROUP BY text),
marks AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         map {'A': coalesce(words, 0) < 200, 'B': 100 * coalesce(kinds, 0) < 50 * coalesce(words, 0),
              'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS f
  FROM docs LEFT JOIN counted USING (row) LEFT JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE length(replace(replace(replace(replace(replace(a.x || b.x || c.x || d.x || e.x, 'A', ''), 'B', ''), 'C', ''), 'D', ''), 'E', '')) = 0
    AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
each AS (
  SELECT part, filter_order, step::int AS step, good, toxic, f[filter_order[step]] AS own,
         list_bool_or(list_transform(range(1, step), lambda k: f[filter_order[k]])) AS earlier,
         len(list_filter(map_values(f), lambda v: v)) AS n_fails
  FROM fails, orders, range(1, 6) s(step)),
steps AS (
  SELECT part, filter_order, step, filter_order[step] AS letter,
         count(*) FILTER (NOT own AND NOT coalesce(earlier, false)) AS kept,
         count(*) FILTER (own AND NOT coalesce(earlier, false)) AS removed,
         count(*) FILTER (own AND coalesce(earlier, false)) AS redundant,
         count(*) FILTER (own AND n_fails = 1) AS unique_fails,
         count(*) FILTER (own AND NOT coalesce(earlier, false) AND good = 1) AS good_lost,
         count(*) FILTER (own AND NOT coalesce(earlier, false) AND toxic = 1) AS toxic_lost
  FROM each GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::bigint AS shapley
FROM steps
"""
