"""Pack documents into training sequences by linear grouping and best fit.

Lengths are whole numbers up to the limit, so a histogram of at most ``limit`` counts holds the whole packing
problem.  The plan is made from it in runs (so many pieces of one length, into so many sequences from this
number on) and its size does not depend on the number of documents; pieces then look up their place by their
rank among the pieces of their length.  A training order is kept by packing each run of it on its own.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taleframe.llm.common import read, stage, stage_in_buckets
from taleframe.llm.tokens import VOCABULARY, DocumentEncoder

LIMIT = 1024
END = 2
#: (groups, share of the limit above which a length is large) that are tried; the plan with the fewest
#: sequences is kept.  Large lengths are grouped, rounded up and put in configurations.
SCHEMES = ((64, 1 / 8), (48, 1 / 3), (24, 1 / 2))
#: Characters that are encoded before their pieces are handed on.
BATCH_CHARS = 1 << 20
#: Sequences of a run are numbered from run << RUN_BITS on.
RUN_BITS = 40


# --- the plan, from a histogram -------------------------------------------------------------------------


def linear_groups(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count), longest first, dealt into groups of equal cardinality."""
    total, out, done = int(counts.sum()), [], 0
    ends = [(i + 1) * total // groups for i in range(groups)]
    ends = [e for e in dict.fromkeys(ends) if e]
    runs = [(int(n), int(c)) for n, c in zip(lengths[::-1], counts[::-1], strict=True) if c]
    k = 0
    current: list[tuple[int, int]] = []
    for n, c in runs:
        while c:
            take = min(c, ends[k] - done)
            current.append((n, take))
            done, c = done + take, c - take
            if done == ends[k]:
                out.append(current)
                current, k = [], k + 1
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, limit: int) -> list[tuple[np.ndarray, float]]:
    """Patterns over a few sizes and how often each is used: the packing program relaxed to real numbers.

    Columns are generated by a knapsack over the limit; ``sizes`` are distinct.
    """
    k = len(sizes)
    scale = float(demand.sum())
    b = demand / scale
    basis = np.diag((limit // sizes).astype(float))
    order = np.argsort(sizes)
    rising = sizes[order]
    for _ in range(12 * k + 50):
        y = np.linalg.solve(basis.T, np.ones(k))
        value, choice = np.zeros(limit + 1), np.full(limit + 1, -1)
        gain = y[order]
        for c in range(int(rising[0]), limit + 1):
            m = int(np.searchsorted(rising, c, side="right"))
            v = value[c - rising[:m]] + gain[:m]
            j = int(v.argmax())
            if v[j] > value[c - 1]:
                value[c], choice[c] = v[j], order[j]
            else:
                value[c] = value[c - 1]
        if value[limit] <= 1 + 1e-9:
            break
        column, c = np.zeros(k), limit
        while c >= rising[0]:
            if choice[c] < 0:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= int(sizes[choice[c]])
        x, d = np.linalg.solve(basis, b), np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-10, x / np.where(d > 1e-10, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, b) * scale
    return [(basis[:, j].astype(int), float(x[j])) for j in range(k) if x[j] >= 1]


class _Room:
    """Open sequences as runs: for each free length, (first sequence, number of sequences)."""

    def __init__(self, limit: int):
        self.limit, self.by, self.free = limit, {}, []

    def add(self, free: int, first: int, n: int) -> None:
        if n and free:
            if free not in self.by:
                self.by[free] = []
                bisect.insort(self.free, free)
            self.by[free].append((first, n))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        i = bisect.bisect_left(self.free, length)
        if i == len(self.free):
            return None
        free = self.free[i]
        first, n = self.by[free].pop()
        if not self.by[free]:
            del self.by[free]
            self.free.pop(i)
        return free, first, n


def packing_plan(counts: np.ndarray, limit: int = LIMIT, groups: int = 64, large: float = 1 / 8) -> tuple[list[tuple], int]:
    """Rows (length, low, n, sequence, offset, per) and the number of sequences, for ``counts[length]`` pieces.

    The pieces of a length with ranks low to low + n go ``per`` to a sequence, from ``sequence`` and ``offset`` on.
    """
    counts = np.asarray(counts, dtype=np.int64)
    left, used = counts.copy(), np.zeros(limit + 1, dtype=np.int64)
    rows: list[tuple] = []
    room, sequences = _Room(limit), 0

    def put(length: int, n: int, sequence: int, offset: int, per: int) -> None:
        rows.append((length, int(used[length]), n, sequence, offset, per))
        used[length] += n
        left[length] -= n

    if left[limit]:
        put(limit, int(left[limit]), 0, 0, 1)
        sequences = int(counts[limit])
    big = np.arange(limit + 1) > limit * large
    big[limit] = False
    lengths = np.flatnonzero(big & (left > 0))
    if len(lengths):
        grouped = linear_groups(lengths, left[lengths], groups)
        merged: dict[int, list[tuple[int, int]]] = {}
        for g in grouped:
            merged.setdefault(g[0][0], []).extend(g)  # rounded up to the group's longest
        sizes = np.array(sorted(merged, reverse=True))
        queues = [list(merged[int(s)]) for s in sizes]
        demand = np.array([sum(c for _, c in q) for q in queues], dtype=float)
        for pattern, times in configurations(sizes, demand, limit):
            times = int(times + 1e-7)
            bins = [(sequences, times, 0)]  # first, number, filled
            sequences += times
            for i in np.flatnonzero(pattern):
                for _ in range(int(pattern[i])):
                    nxt, queue = [], queues[i]
                    for first, n, filled in bins:
                        while n and queue:
                            length, c = queue[0]
                            take = min(n, c)
                            put(length, take, first, filled, 1)
                            nxt.append((first, take, filled + length))
                            first, n = first + take, n - take
                            if take == c:
                                queue.pop(0)
                            else:
                                queue[0] = (length, c - take)
                        if n:
                            nxt.append((first, n, filled))
                    bins = nxt
            for first, n, filled in bins:
                room.add(limit - filled, first, n)
    for length in range(limit - 1, 0, -1):  # what is left over of the large ones, then the small ones
        while left[length]:
            place, n = room.tightest(length), int(left[length])
            if place is None:
                place = (limit, sequences, -(-n // (limit // length)))
                sequences += place[2]
            free, first, m = place
            per = free // length
            full = min(m, n // per)
            if full:
                put(length, full * per, first, limit - free, per)
                room.add(free - per * length, first, full)
            first, m, n = first + full, m - full, n - full * per
            if m and n and n < per:
                put(length, n, first, limit - free, n)
                room.add(free - n * length, first, 1)
                first, m = first + 1, m - 1
            room.add(free, first, m)
    return rows, sequences


# --- pieces and their places ----------------------------------------------------------------------------


def training_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with run and place, its order of training: the number of its part file, and the row in it.

    Writers of sorted tables number their part files in order.  Rows that do not come straight from Parquet files
    are one run, in the order of their partitions.
    """
    try:
        held = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.lit(0).cast("long").alias("run"), F.monotonically_increasing_id().alias("place"))
    number = lambda pattern: F.coalesce(F.regexp_extract("file", pattern, 1).try_cast("long"), F.lit(0))
    return held.select("doc_id", "text", number(r"^part-(\d+)").alias("run"), (F.shiftleft(number(r"-c(\d+)\."), 40) + F.col("at")).alias("place"))


def tokenized_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids: doc_id, run, place, piece, start, length, ids_crc32, part, local (and ids).

    ``docs`` has doc_id, text, run and place; ``local`` counts pieces of equal run and length earlier in partition ``part``.
    """
    names = ["doc_id", "run", "place", "piece", "start", "length", "ids_crc32", "part", "local"] + ["ids"] * with_ids
    last = np.array([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = DocumentEncoder.shared(vocabulary)
        part, seen = TaskContext.get().partitionId(), {}
        for whole in batches:
            at, size = 0, len(whole)
            runs, columns = whole.column("run").to_pylist(), whole.column("text")
            while at < size:
                texts: list[str] = []
                chars, first = 0, at
                while at < size and (not texts or chars < BATCH_CHARS):
                    texts.append(columns[at].as_py() or "")
                    chars, at = chars + len(texts[-1]), at + 1
                row, fields, held_ids = [], [], []
                for i, ids in enumerate(encoder.encode(texts), start=first):
                    ids += last
                    n = len(ids) // 4
                    count = seen.get(runs[i])
                    if count is None:
                        count = seen[runs[i]] = [0] * (limit + 1)
                    edges = [0, *range((n - 1) % limit + 1, n + 1, limit)]
                    for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                        held = ids[4 * a : 4 * z]
                        row.append(i)
                        fields.append((k, a, z - a, zlib.crc32(held), part, count[z - a]))
                        count[z - a] += 1
                        if with_ids:
                            held_ids.append(held)
                given = whole.select(["doc_id", "run", "place"]).take(pa.array(row, pa.int64()))
                made = np.array(fields, dtype=np.int64).reshape(-1, 6).T
                out = [*given.columns, pa.array(made[0].astype(np.int32)), *map(pa.array, made[1:4]), pa.array(made[4].astype(np.int32)), pa.array(made[5])]
                if with_ids:
                    edge = np.r_[0, np.cumsum(made[2])].astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(edge), pa.array(np.frombuffer(b"".join(held_ids), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, run long, place long, piece int, start long, length long, ids_crc32 long, part int, local long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "run", "place", "text").mapInArrow(cut, schema)


def _plans(counts: DataFrame, limit: int, schemes: tuple[tuple[int, float], ...]) -> DataFrame:
    """run, length, runs: the plan of each run, made where its histogram (at most ``limit`` rows) is."""

    def plan(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        held = np.zeros(limit + 1, dtype=np.int64)
        held[t.column("length").to_numpy()] = t.column("n").to_numpy()
        rows, _ = min((packing_plan(held, limit, *s) for s in schemes), key=lambda p: p[1])
        by_length: dict[int, list] = {}
        for length, low, n, sequence, offset, per in sorted(rows):
            by_length.setdefault(length, []).append({"low": low, "sequence": sequence, "offset": offset, "per": per})
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("low", "sequence", "offset", "per")]))
        return pa.table({"run": pa.array([key[0].as_py()] * len(by_length), pa.int64()), "length": pa.array(list(by_length), pa.int64()), "runs": pa.array(list(by_length.values()), kind)})

    # a plan takes a second or so: runs are dealt to as many tasks as there may be, small as their histograms are
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.repartition(n, "run").groupBy("run").applyInArrow(plan, "run long, length long, runs array<struct<low:long,sequence:long,offset:long,per:long>>")


def pack_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, end: int = END, schemes: tuple[tuple[int, float], ...] = SCHEMES, with_ids: bool = False, ordered: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A null text is empty and still has its end token.  A document of more than ``limit`` ids is cut so that
    all pieces but the first are full.  Repeated documents are packed as often as they come.  An empty table
    gives an empty result; other columns are ignored.  With ``ordered``, rows come from files in the order of
    training: sequences of a part file hold its pieces only and are numbered after those of the files before it;
    run and place (file, row in it) tell copies of a document apart.
    """
    source = training_runs(docs) if ordered else docs.select("doc_id", "text", F.lit(0).cast("long").alias("run"), F.lit(None).cast("long").alias("place"))
    pieces = tokenized_pieces(source, vocabulary, limit, end, with_ids)
    pieces = stage_in_buckets(pieces, "pieces", ["run", "part"]) if ordered else stage(pieces, "pieces")
    held = stage(pieces.groupBy("run", "part", "length").agg(F.count("*").alias("n")), "piece-counts")
    plan = stage(_plans(held.groupBy("run", "length").agg(F.sum("n").alias("n")), limit, schemes), "plan")
    earlier = Window.partitionBy("run", "length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("run", "part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if ordered:  # one row for each run of a part, at most ``limit`` entries; pieces and their ids stay in their buckets
        seats = base.join(plan, ["run", "length"]).groupBy("run", "part").agg(F.map_from_entries(F.collect_list(F.struct("length", F.struct("base", "runs")))).alias("seats"))
        placed = pieces.join(seats, ["run", "part"]).withColumn("seat", F.element_at("seats", F.col("length"))).select("*", "seat.*")
    else:  # one run: at most ``limit`` rows
        placed = pieces.join(base, ["run", "part", "length"]).join(F.broadcast(plan), ["run", "length"])
    placed = placed.withColumn("rank", F.col("base") + F.col("local"))
    placed = placed.withColumn("put", F.element_at(F.filter("runs", lambda r: r["low"] <= F.col("rank")), -1))
    at = F.col("rank") - F.col("put.low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.shiftleft("run", RUN_BITS) + F.col("put.sequence") + F.floor(at / F.col("put.per"))).alias("sequence_id"),
        (F.col("put.offset") + at % F.col("put.per") * F.col("length")).alias("offset"),
        *(["run", "place"] if ordered else []),
        *(["ids"] if with_ids else []),
    )


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every row of documents and their places in sequences of at most 1024 tokens.

    A null or empty text is its end token; texts of any length are encoded whole; repeated rows and ids are packed
    as often as they come; other columns are ignored; an empty table gives an empty result.
    """
    return pack_documents(read(spark, sf_dir, "documents"))
