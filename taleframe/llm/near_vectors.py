"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors at cosine >= c lie within squared distance 2 - 2c.  After one rotation the coordinates are cut into
blocks; two such vectors lie, in at least one block, within that block's proportional share of the budget.  Each
block is range-joined on a grid over its first two coordinates, and the union of candidates is verified exactly.

Pairs are never spelled out as rows.  A cell's first task sees the coordinates of one block and tells which vectors have
a candidate there; its second sees these vectors whole, verifies every pair and counts it if no earlier block admits
it, and returns a count and a tree for each vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleframe.llm.common import read, salted_join, stage
from taleframe.llm.components import components

COSINE, BLOCK = 0.93, 8
#: Rows of a grid cell that one task compares with each other; larger cells are dealt into chunks.
CELL_ROWS = 4096
#: Room for rounding: squared distances of single precision are compared with a little more than their share,
#: those of double precision with TIGHT more; what lies nearer to a bound than TIGHT is worked out pair by pair.
SLACK, TIGHT = 1e-6, 1e-9
STEP = 256


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def rotation(width: int, seed: int = 11) -> np.ndarray:
    """The same random orthogonal matrix everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def _unit(e: np.ndarray) -> np.ndarray:
    e = e / np.abs(e).max(axis=1, keepdims=True)
    return e / np.sqrt((e * e).sum(axis=1, keepdims=True))


def _by_width(b: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = np.diff(b.column(name).offsets.to_numpy()) if len(b) else np.zeros(0)
    for w in np.unique(widths):
        yield int(w), b.filter(pa.array(widths == w))


def _placed(units: DataFrame, cosine: float, block: int) -> DataFrame:
    """Each vector in its own grid cell of every block, and as a visitor in the cells that follow."""
    budget = 2 - 2 * cosine

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for width, b in _by_width(whole, "unit"):
                turned = _matrix(b.column("unit"), width) @ rotation(width)
                for k, at in enumerate(range(0, width, block)):
                    x = turned[:, at : at + block]
                    reach = np.sqrt(budget * x.shape[1] / width) + SLACK
                    cx = np.floor(x[:, 0] / reach).astype(np.int32)
                    cy = np.floor(x[:, 1] / reach).astype(np.int32) if x.shape[1] > 1 else np.zeros(len(x), np.int32)
                    coords = pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
                    for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
                        yield pa.RecordBatch.from_arrays(
                            [b.column("rid"), b.column("label"), pa.array(np.full(len(x), width, np.int32)), pa.array(np.full(len(x), k, np.int32)),
                             pa.array(cx + dx), pa.array(cy + dy), pa.array(np.full(len(x), (dx, dy) == (0, 0))), coords],
                            ["rid", "label", "width", "block", "cx", "cy", "home", "x"],
                        )

    kind = units.schema["label"].dataType.simpleString()
    return units.select("rid", "label", "unit").mapInArrow(place, f"rid long, label {kind}, width int, block int, cx int, cy int, home boolean, x array<float>")


CELL = ("label", "width", "block", "cx", "cy")


def _in_chunks(cells: DataFrame) -> DataFrame:
    """Rows of cells with a home row and another one; a row of chunk i of a large cell meets chunk j in the task (least, greatest)."""
    sizes = cells.groupBy(*CELL).agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes")).where("homes > 0 and n > 1")
    sizes = sizes.withColumn("chunks", F.ceil(F.col("n") / CELL_ROWS).cast("int")).drop("n", "homes")
    dealt = cells.join(sizes, [*CELL]).withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("chunks", "other")


def _partners(rows: np.ndarray, near: np.ndarray, rid: np.ndarray, home: np.ndarray, chunk: np.ndarray, apart: bool) -> np.ndarray:
    """``near`` without what other cells or tasks see: each home row's pairs with visitors, and once with home rows after it."""
    near &= rid[rows][:, None] != rid[None, :]
    near &= ~home[None, :] | (rid[rows][:, None] < rid[None, :])
    if apart:
        near &= chunk[rows][:, None] != chunk[None, :]
    return near


def _involved(placed: DataFrame, cosine: float) -> DataFrame:
    """CELL, rid, home of the vectors that have a candidate in a cell."""
    budget = 2 - 2 * cosine

    def join(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        width = t.column("width")[0].as_py()
        rid, home, chunk = (t.column(c).to_numpy() for c in ("rid", "home", "chunk"))
        x = np.stack(t.column("x").to_numpy()).astype(np.float64)
        reach = budget * x.shape[1] / width + SLACK
        apart = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        norm = (x * x).sum(axis=1)
        seen, homes = np.zeros(len(rid), dtype=bool), np.flatnonzero(home)
        for a in range(0, len(homes), STEP):
            rows = homes[a : a + STEP]
            near = norm[rows][:, None] + norm[None, :] - 2 * (x[rows] @ x.T) <= reach
            near = _partners(rows, near, rid, home, chunk, apart)
            seen[rows] |= near.any(axis=1)
            seen |= near.any(axis=0)
        return t.select([*CELL, "rid", "home"]).filter(pa.array(seen))

    kind = placed.schema["label"].dataType.simpleString()
    schema = f"label {kind}, width int, block int, cx int, cy int, rid long, home boolean"
    return _in_chunks(placed).groupBy(*CELL, "lo", "hi").applyInArrow(join, schema).distinct()


def _verified(involved: DataFrame, units: DataFrame, cosine: float, block: int) -> DataFrame:
    """rid, linked (copies of the classes linked in a task), root (smallest rid of its tree there)."""
    budget = 2 - 2 * cosine

    def count(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        mine, width = t.column("block")[0].as_py(), t.column("width")[0].as_py()
        rid, home, chunk, copies = (t.column(c).to_numpy() for c in ("rid", "home", "chunk", "copies"))
        apart = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        u = _matrix(t.column("unit").chunk(0), width)
        turned = u @ rotation(width)
        parts = [turned[:, a : a + block] for a in range(0, width, block)][: mine + 1]
        norms = [(x * x).sum(axis=1) for x in parts]
        linked, tree = np.zeros(len(rid), dtype=np.int64), np.arange(len(rid))
        homes = np.flatnonzero(home)
        for a in range(0, len(homes), STEP):
            rows = homes[a : a + STEP]
            cos = u[rows] @ u.T
            near = _partners(rows, cos >= cosine - TIGHT, rid, home, chunk, apart)
            i, j = np.nonzero(near & (np.abs(cos - cosine) <= TIGHT))
            near[i, j] = (u[rows[i]] * u[j]).sum(axis=1) >= cosine
            for k, x in enumerate(parts):
                share = budget * x.shape[1] / width + TIGHT
                d = norms[k][rows][:, None] + norms[k][None, :] - 2 * (x[rows] @ x.T)
                admits = d <= share
                i, j = np.nonzero(near & (np.abs(d - share) <= TIGHT))
                admits[i, j] = ((x[rows[i]] - x[j]) ** 2).sum(axis=1) <= share
                near &= admits if k == mine else ~admits
            linked[rows] += near @ copies
            linked += copies[rows] @ near
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                trees = tree[np.flatnonzero(near[i])]
                if (trees != tree[rows[i]]).any():
                    trees = np.unique(np.r_[trees, tree[rows[i]]])
                    tree[np.isin(tree, trees)] = trees[0]
        root = np.full(len(rid), np.iinfo(np.int64).max)
        np.minimum.at(root, tree, rid)
        found = np.flatnonzero(linked)
        return pa.table({"rid": rid[found], "linked": linked[found], "root": root[tree[found]]})

    whole = _in_chunks(involved).join(units.select("rid", "copies", "unit"), "rid")
    return whole.groupBy(*CELL, "lo", "hi").applyInArrow(count, "rid long, linked long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows link if their labels are equal and not null, their vectors have one length and their cosine is at least
    ``cosine`` (above 0).  A vector that is null, empty, zero, or holds a null or non-finite component links with
    nothing: no links, a component of its own.  Equal vectors of a label are one class that is compared once
    and counted as often as it comes; rows that share a vec_id are vectors of their own.  component_id is the
    smallest vec_id reachable (nulls last); kept says that it is the row's own.  Other columns are ignored.
    """
    rows = stage(vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("e", lambda x: x != 0)
    sound = F.coalesce(F.col("label").isNotNull() & sound, F.lit(False))
    good = rows.where(sound)

    def to_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for width, b in _by_width(whole, "e"):
                units = _unit(_matrix(b.column("e"), width))
                yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("label"), b.column("copies"), pa.array(list(units), pa.list_(pa.float64()))], ["rid", "label", "copies", "unit"])

    kind = rows.schema["label"].dataType.simpleString()
    classes = good.groupBy("label", "e").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"))
    units = stage(classes.select("rid", "label", "copies", "e").mapInArrow(to_unit, f"rid long, label {kind}, copies long, unit array<double>"), "units")
    involved = stage(_involved(_placed(units, cosine, block), cosine), "vector-cells")
    found = stage(_verified(involved, units, cosine, block), "vector-links")
    own = units.select("rid", "copies")
    direct = found.groupBy("rid").agg(F.sum("linked").alias("linked"))
    roots = components(found.select(F.col("rid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rid")
    per_class = own.join(direct, "rid", "left").join(roots, "rid", "left").select(
        F.col("rid").alias("first"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rid").alias("root"), "copies"
    )
    # a class of one row needs no second look at the vectors
    single = per_class.where("copies = 1").select(F.col("first").alias("rid"), "n_links", "root")
    shared = classes.where("copies > 1").select("label", "e", F.col("rid").alias("first"))
    shared = stage(shared.join(per_class, "first").select("label", "e", "copies", "n_links", "root"), "vector-copies")
    copied = salted_join(good.select("rid", "label", "e"), shared, ["label", "e"], "copies", "rid").select("rid", "n_links", "root")
    placed = rows.select("vec_id", "rid").join(single.unionByName(copied), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    placed = stage(placed.select("vec_id", "rid", F.coalesce("n_links", F.lit(0)).alias("n_links"), "root"), "vector-classes")
    least = stage(placed.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n")), "vector-roots")
    return salted_join(placed, least, ["root"], "n", "rid").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of all rows of embeddings, at cosine 0.93 and more.

    Null, empty, zero and non-finite vectors, and rows without a label, link with nothing; equal vectors link with each other;
    ties go to the smaller vec_id; rows that share one are vectors of their own; other columns are ignored; an empty table gives
    an empty result.
    """
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::double[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT t.vec_id, coalesce(n, 0)::bigint AS n_links, component_id, t.vec_id = component_id AS kept
FROM embeddings t JOIN c ON c.u = t.vec_id LEFT JOIN (SELECT u, count(*) AS n FROM p GROUP BY u) l ON l.u = t.vec_id
"""
