"""Near-duplicate documents by circulant MinHash, banding, and exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleframe.llm.common import DOCUMENT_COLUMNS, SALTS, noted, read, remove, salted_join, stage
from taleframe.llm.components import components
from taleframe.llm.shingles import batches_of, mix, shingle_sets, slices

#: Words of a shingle and least similarity in percent, where a caller names none.
WORDS, PERCENT = 5, 80
#: A pair of similarity 0.8 shares none of 40 bands of 5 coordinates with probability 0.672 ** 40, about 1e-7.
BANDS, ROWS = 40, 5
#: Bits of the filter that spares documents without a candidate partner; its size never changes.
FILTER_BITS = 1 << 24
_FILTER_BLOCKS = 64
_COLUMNS = 4096
#: Documents of one chunk when the members of a neighbourhood are compared.
CHUNK = 512


def _second_permutation(x: np.ndarray) -> None:
    """In place, a bijection of the circle of 2**32 places."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: the first permutation puts each shingle on the circle; coordinate k shifts the circle
    by k, applies the second permutation and keeps the smallest place."""
    places = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(places), _COLUMNS):
        x = places[None, a : a + _COLUMNS] + shifts
        _second_permutation(x)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, different for each band's number."""
    by_band = least.reshape(bands, rows).astype(np.uint64)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + by_band[:, k])
    return key.view(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two halves of a digest of a set of shingles, 0 for an empty one."""
    s = s.view(np.uint64)
    if not len(s):
        return 0, 0
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, two halves of a digest of the set, and the band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            n, one, two, keys = [], [], [], []
            for _, part in batches_of(texts):
                for s in shingle_sets(part, words):
                    n.append(len(s))
                    for half, value in zip((one, two), _digest(s), strict=True):
                        half.append(value)
                    keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "one", "two", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, one long, two long, keys array<long>")


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit per slot, set if an id falls there: FILTER_BITS bits whatever the number of ids."""
    width = FILTER_BITS // _FILTER_BLOCKS

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _slots(b.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(s // width), pa.array(s % width)], ["block", "bit"])

    def block(t: pa.Table) -> pa.Table:
        bits = np.zeros(width, dtype=bool)
        bits[t.column("bit").to_numpy()] = True
        return pa.table({"block": [t.column("block")[0].as_py()], "bits": [np.packbits(bits).tobytes()]})

    spread = ids.select("id").mapInArrow(slots, "block long, bit long").distinct()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in spread.groupBy("block").applyInArrow(block, "block long, bits binary").collect():  # one row a block
        out[r["block"] * width // 8 : (r["block"] + 1) * width // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, one, two (digest), shingles (whole set) of the documents among ``ids``."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(ids))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for b in slices(batches):
            s = _slots(b.column("id").to_numpy(zero_copy_only=False))
            b = b.filter(pa.array((held[s // 8] >> (7 - s % 8).astype(np.uint8)) & 1 == 1))
            found = [x.view(np.int64) for _, part in batches_of(b.column("text").to_pylist()) for x in shingle_sets(part, words)]
            one, two = (pa.array([d[k] for d in map(_digest, found)], pa.int64()) for k in (0, 1))
            for a in range(0, len(b), 256):
                lists = pa.array(found[a : a + 256], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(a, 256), one.slice(a, 256), two.slice(a, 256), lists], ["id", "one", "two", "shingles"])

    kept = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null").mapInArrow(sets, "id long, one long, two long, shingles array<long>")
    return kept.join(ids, "id", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    both = pairs.select("u", "v").join(left, "u").join(right, "v")
    shared = both.select("u", "v", (F.size("a") + F.size("b")).cast("long").alias("n"), F.size(F.array_intersect("a", "b")).cast("long").alias("shared"))
    return shared.where(F.col("shared") * 100 >= (F.col("n") - F.col("shared")) * percent).select("u", "v")


def _copies(digested: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: documents whose sets have one digest and are equal element by element.

    Groups of any size are dealt into parts of about CHUNK; a part is read once, each of its sets against the part's first, and
    the first ones of all parts meet again, in as many rounds as the largest group needs.
    """

    def equal(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, whole = None, None
        for b in batches:
            ids, held = b.column("id").to_numpy(), b.column("shingles")
            u = []
            for i in range(len(b)):
                s = held[i].values.to_numpy()
                if first is None:
                    first, whole = int(ids[i]), s
                elif len(s) == len(whole) and (s == whole).all():
                    u.append(int(ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([first] * len(u), pa.int64())], ["u", "v"])

    digest = ["n_shingles", "one", "two"]
    out, now = None, digested.select("id", *digest, "copies")
    while True:
        parts = F.ceil(F.col("copies") / CHUNK).cast("int")
        dealt = now.withColumn("part", F.pmod(F.xxhash64("id"), parts)).join(sets, ["id", "one", "two"])
        found = stage(dealt.select(*digest, "part", "id", "shingles").groupBy(*digest, "part").applyInArrow(equal, "u long, v long"), "copies")
        out = found if out is None else out.unionByName(found)
        first = now.where(F.col("copies") > CHUNK)
        if first.isEmpty():
            return out
        # the first of a part is what no other one was equal to
        first = first.join(found.select(F.col("u").alias("id")), "id", "left_anti").drop("copies")
        again = first.groupBy(*digest).agg(F.count("*").alias("copies")).where("copies > 1")
        now = stage(first.join(again, digest), "copies-left")


def _links_between(hoods: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a neighbourhood: all that share a bucket with the smallest id ``h``.

    Two members were compared already.  A larger neighbourhood is dealt into chunks; each pair of chunks is one
    task that holds their sets and returns the links only.
    """
    placed = hoods.join(found.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left")
    placed = placed.select("h", "id", F.coalesce("c", "id").alias("c"))
    open_ = placed.groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("m > 2 and lo < hi")
    open_ = open_.select("h", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = placed.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS)))
    dealt = salted.join(open_, ["h", "salt"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("h", "id", "c", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, c, chunk = (t.column(x).to_numpy() for x in ("id", "c", "chunk"))
        held = t.column("shingles").chunk(0)
        starts, sizes = held.offsets.to_numpy()[:-1] - held.offsets[0].as_py(), np.diff(held.offsets.to_numpy())
        _, at = np.unique(held.flatten().to_numpy(), return_inverse=True)
        apart = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        kinds, n = np.unique(c, return_counts=True)
        u, v = [], []
        for x in np.flatnonzero(c != kinds[n.argmax()]):  # any pair of two components has one outside the largest
            mark = np.zeros(len(at), dtype=np.int32)
            mark[at[starts[x] : starts[x] + sizes[x]]] = 1
            shared = np.add.reduceat(mark[at], starts)
            near = (shared * 100 >= (sizes + sizes[x] - shared) * percent) & (c != c[x])
            if apart:
                near &= chunk != chunk[x]
            v.append(ids[near])
            u.append(np.full(len(v[-1]), ids[x]))
        none = np.zeros(0, dtype=np.int64)
        return pa.table({"u": np.concatenate([none, *u]), "v": np.concatenate([none, *v])})

    return dealt.join(sets, "id").groupBy("h", "lo", "hi").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (it is its component's smallest).

    Documents whose sets of distinct shingles (A-Z lower-cased, words apart by ASCII white space) are at least
    ``percent`` similar are linked.  A text with fewer words than a shingle is one shingle; a null or blank
    text has none and links with nothing, nor does a row without doc_id (its component is null, it is kept).
    Rows with one doc_id are one node, one row each in the result.  Empty tables give empty results; other
    columns are ignored.

    Equal sets become one class first, by a digest that is confirmed set against set.  In each bucket every class is
    compared with the smallest only; once these links have made components, classes of one bucket that lie in
    different components are compared too, in blocks of bounded size whose pairs are never spelled out as rows, so
    no pair is left undecided.
    """
    digest = ["n_shingles", "one", "two"]
    with noted() as early:
        signed = stage(signatures(docs, words, bands, rows), "signatures")
        usable = signed.where("n_shingles > 0 and doc_id is not null")
        classes = stage(
            usable.groupBy(*digest).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.any_value("keys").alias("keys")), "classes"
        )
    sized = stage(signed.select("doc_id", "n_shingles"), "sizes")
    alone = usable.select(F.col("doc_id").alias("id"), *digest).distinct()
    copied = stage(salted_join(alone, classes.where("copies > 1").select(*digest, "copies"), digest, "copies", "id"), "copied")
    member = classes.select("id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    with noted() as keys:
        shared = stage(member.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("least")).where("c > 1"), "keys")
    members = stage(salted_join(member, shared, ["key"], "c", "id").drop("c"), "members")
    remove(docs.sparkSession, early + keys)
    alike = lambda a, b: (F.greatest(a, b) * percent <= F.least(a, b) * 100)
    first = members.where((F.col("id") != F.col("least.id")) & alike(F.col("n"), F.col("least.n")))
    first = stage(first.select(F.col("id").alias("u"), F.col("least.id").alias("v")).distinct(), "pairs")
    sets = stage(_sets(docs, members.select("id").unionByName(copied.select("id")).distinct(), words), "sets")
    copies, sets = _copies(copied, sets), sets.select("id", "shingles")
    linked = stage(_confirmed(first, sets, percent), "links")
    found = components(linked)
    more = stage(_links_between(members.select(F.col("least.id").alias("h"), "id").distinct(), found, sets, percent), "links")
    trees = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    every = copies.unionByName(trees).unionByName(more)
    last = components(every).withColumnRenamed("node", "doc_id")
    out = sized.join(last, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that a smaller near-duplicate stands for.

    Decided by doc_id: all rows of an id stay or go together, rows without one stay, and so do null and blank texts.  Very long
    texts are read whole; columns other than those of documents go; an empty table gives an empty result.
    """
    gone = near_duplicates(docs, **options).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of each component of near-duplicate rows: that of the smallest doc_id (null last), then row.

    Rows, not ids, are the nodes here, so repeated rows and copies without doc_id go, and a different text under
    the id of a copy stays.  A null or blank text links with nothing and stays.
    """
    rows = stage(docs.select(*DOCUMENT_COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    kept = found.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(first).select("first.row")
    return rows.join(kept, "row", "left_semi").select(*DOCUMENT_COLUMNS)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all rows of documents: sets of two words, 80 of 100 alike.

    Null and blank texts have no shingle and link with nothing; texts of any length are read whole; equal texts link; the smallest
    doc_id names a component; rows of one id are one node; other columns are ignored; an empty table gives an empty result.
    """
    return near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u)
SELECT s.doc_id, len(s)::bigint AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT u, min(v) AS component_id FROM r GROUP BY u) c ON c.u = s.doc_id
"""
