"""Exact top-k search: an inverted index per shard, BM25 with block-max WAND pruning, merged over shards.

A shard indexes a run of documents of one input partition, so no text is shuffled.  Scores use the number of
documents, their mean length and document frequencies of the whole corpus.  Shards are searched in phases, each
about eight times as large as the one before: a query's k-th best score so far is the floor of the next phase, so
each phase adds some 8 k rows a query to those that are merged, however many shards there are.

Inside a shard documents lie in groups that share their common words (languages, say), and WAND's tests are made for a
group and many queries at once.  Every list has an upper bound in its group; a query whose lists' bounds together stay under
its floor reads nothing there.  Lists of few documents are walked and scored.  Frequent lists are optional: they are
read only if the block maxima of all lists reach the floor in some block, and then as rows of a matrix, by one product in
single precision for all such queries, whose error has a bound.  Documents that can reach the floor are scored in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from taleframe.llm.common import read, stage
from taleframe.llm.shingles import batches_of, slices, word_hashes

K, K1, B = 10, 1.2, 0.75
#: Postings and documents of a shard, at most (one document may have more postings); documents of one block.
SHARD_POSTINGS, SHARD, BLOCK = 3_000_000, 16384, 128
#: Query terms that one round sends to all shards, about; there are as many rounds as the queries need.
ROUND_TERMS = 2_000_000
#: Each phase searches this many times the shards of the one before.
PHASE = 8
#: A list with a posting in one of so many documents of its group is kept as a dense row, up to so many cells a group.
DENSE, DENSE_CELLS = 20, 16_000_000
#: Queries that a shard takes at once.
QUERIES = 2048
#: Cells (query and document) of a batch of queries, and postings that are added up at once, about.
BATCH_CELLS, BATCH_POSTINGS = 1_200_000, 40_000
#: Groups of fewer than twice so many documents are not divided; words are told apart by so many bits there, and so many columns are compared.
GROUP, GROUP_BITS, GROUP_COLUMNS = 1024, 16, 128
#: A division leaves at most this share of the variance along its line; halves of one bell curve leave 0.36.
WITHIN = 0.2
#: Scores closer than this are equal.
PLACES = 6
_SLACK = 2 * 10.0**-PLACES


def _term_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct term hashes, counts) of each text."""
    for _, part in batches_of(texts):
        hashes, bounds = word_hashes(part)
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(hashes[a:z], return_counts=True)


def _groups(found: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Documents in groups that share common words (languages, say), those of a group by their number of terms.

    Where two clouds of documents lie apart along the line of most variance, they are divided, and each again.  Groups
    only decide what is read together: any division gives the same results.
    """
    held = np.array([len(t) for t, _ in found])
    by_size = np.argsort(held, kind="stable")
    if len(found) < 2 * GROUP:
        return [by_size]
    bucket = (np.concatenate([t for t, _ in found]) & np.uint64((1 << GROUP_BITS) - 1)).astype(np.int64)
    column = np.full(1 << GROUP_BITS, -1)
    column[np.argsort(-np.bincount(bucket, minlength=1 << GROUP_BITS), kind="stable")[:GROUP_COLUMNS]] = np.arange(GROUP_COLUMNS)
    column = column[bucket]
    common = np.flatnonzero(column >= 0)
    has = np.zeros((len(found), GROUP_COLUMNS))
    has[np.repeat(np.arange(len(found)), held)[common], column[common]] = 1
    has /= np.maximum(np.sqrt(has.sum(axis=1, keepdims=True)), 1)
    out, todo = [], [by_size]
    while todo:
        docs = todo.pop()
        if len(docs) >= 2 * GROUP:
            x = has[docs] - has[docs].mean(axis=0)
            along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
            cut, last = 0.0, None
            while cut != last:  # two means
                last, left = cut, along <= cut
                if not 0 < left.sum() < len(docs):
                    break
                cut = (along[left].mean() + along[~left].mean()) / 2
            least = min(left.sum(), (~left).sum())
            if least >= GROUP // 4 and along[left].var() * left.mean() + along[~left].var() * (~left).mean() <= WITHIN * along.var():
                todo += [docs[~left], docs[left]]
                continue
        out.append(docs)
    return out


def _shard(name: int, ids: list[int | None], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row of the index, of documents and their (distinct term hashes, counts)."""
    groups = _groups(found)
    order = np.concatenate(groups).tolist()
    ids, found = [ids[i] for i in order], [found[i] for i in order]
    sizes = np.array([int(n.sum()) for _, n in found], dtype=np.int32)
    term = np.concatenate([t for t, _ in found]).view(np.int64)
    doc = np.repeat(np.arange(len(found), dtype=np.int32), [len(t) for t, _ in found])
    tf = np.concatenate([n for _, n in found]).astype(np.int32)
    order = np.argsort(term, kind="stable")
    term, doc, tf = term[order], doc[order], tf[order]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([int(sizes.sum())]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tobytes()]), pa.array([np.cumsum([0, *map(len, groups)])], pa.list_(pa.int32())),
         pa.array([term[first]], pa.list_(pa.int64())), pa.array([np.r_[first, len(term)].astype(np.int32)], pa.list_(pa.int32())), pa.array([doc.tobytes()]), pa.array([tf.tobytes()])],
        ["shard", "words", "doc_ids", "sizes", "groups", "terms", "starts", "posting", "tf"],
    )


def build_index(docs: DataFrame) -> DataFrame:
    """Shards: shard, words (in all), doc_ids, sizes (words), groups (edges of documents), terms, starts (of each term's postings), posting (document), tf."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        shard = TaskContext.get().partitionId() << 33

        postings = 0
        for b in slices(batches):
            ids_here = b.column("doc_id").to_pylist()
            for i, pair in zip(ids_here, _term_counts(b.column("text").to_pylist()), strict=True):
                if ids and (len(ids) == SHARD or postings + len(pair[0]) > SHARD_POSTINGS):
                    yield _shard(shard, ids, found)
                    ids, found, shard, postings = [], [], shard + 1, 0
                ids.append(i)
                found.append(pair)
                postings += len(pair[0])
        if ids:
            yield _shard(shard, ids, found)

    schema = "shard long, words long, doc_ids array<long>, sizes binary, groups array<int>, terms array<long>, starts array<int>, posting binary, tf binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, schema)


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term: the distinct terms of each query."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (t, _) in zip(b.column("qid").to_pylist(), _term_counts(b.column("text").to_pylist()), strict=True):
                if len(t):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), i, dtype=np.int64)), pa.array(t.view(np.int64))], ["qid", "term"])

    return queries.mapInArrow(terms, "qid long, term long").distinct()


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges lo..hi, one after the other."""
    sizes = hi - lo
    return np.repeat(lo - np.cumsum(np.r_[0, sizes[:-1]]), sizes) + np.arange(int(sizes.sum()))


class _Group:
    """Documents of a shard that share most of their words: their lists, block maxima and upper bounds."""

    def __init__(self, first: int, n: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int, block: int):
        self.first, self.n, self.doc, self.impact = first, n, doc.astype(np.int64), impact
        self.starts = np.r_[0, np.cumsum(np.bincount(term, minlength=terms))]
        self.df = df = np.diff(self.starts)
        self.upper = np.zeros(terms)
        some = np.flatnonzero(df)
        if len(some):
            self.upper[some] = np.maximum.reduceat(impact, self.starts[some])
        often = np.flatnonzero(df * DENSE >= n) if n else some
        if len(often) * n > DENSE_CELLS:
            often = np.sort(often[np.argsort(-df[often], kind="stable")[: DENSE_CELLS // n]])
        self.row = np.full(terms, -1, dtype=np.int32)
        self.row[often] = np.arange(len(often))
        row = self.row[term]
        at = np.flatnonzero(row >= 0)
        # dense rows in single precision find candidates; impacts in double precision score them
        self.key, self.exact = row[at].astype(np.int64) * n + doc[at], impact[at]
        self.dense = np.zeros((len(often), n), dtype=np.float32)
        self.dense.reshape(-1)[self.key] = self.exact
        self.edges = np.arange(0, n, block)
        self.widths = np.diff(np.r_[self.edges, n])
        self.dense_best = np.maximum.reduceat(self.dense, self.edges, axis=1) if n and len(often) else np.zeros((len(often), len(self.edges)), dtype=np.float32)
        #: A sum of products of so many non-negative numbers in single precision is off by at most this share.
        self.off = (len(often) + 8) * 2.0**-23

    def search(self, query: np.ndarray, at: np.ndarray, idf: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, document, score) of all that may be among the k best and reach their floors, which rise meanwhile.

        ``query`` numbers the queries in order; ``at`` and ``idf`` are their terms' lists in this shard.
        """
        # a query whose lists' upper bounds together stay under its floor reads nothing
        most = self.upper[at] * idf
        upper = np.bincount(query, weights=most, minlength=len(floors))
        here = np.flatnonzero((most > 0) & (upper >= floors - _SLACK)[query])
        query, at, idf = query[here], at[here], idf[here]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=np.int64)
        bounds = np.r_[first, len(query)]
        most = max(1, BATCH_CELLS // max(self.n, 1))
        for i in range(0, len(first), most):
            a, z = bounds[i], bounds[min(i + most, len(first))]
            names = query[first[i : i + most]]
            yield self._batch(names, np.repeat(np.arange(len(names)), np.diff(bounds[i : i + most + 1])), at[a:z], idf[a:z], floors, k)

    def _short(self, m: int, query: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """What the lists add to the scores of m queries."""
        scores = np.zeros(m * self.n)
        lo, sizes, cell = self.starts[at], self.df[at], query * self.n
        cost = np.cumsum(sizes)
        a = 0
        while a < len(at):
            z = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + BATCH_POSTINGS, side="right")))
            size = sizes[a:z]
            posting = np.repeat(lo[a:z] - np.cumsum(np.r_[0, size[:-1]]), size)
            posting += np.arange(len(posting))
            to = self.doc.take(posting, mode="clip")
            to += np.repeat(cell[a:z], size)
            add = self.impact.take(posting, mode="clip")
            add *= np.repeat(idf[a:z], size)
            np.add.at(scores, to, add)
            a = z
        return scores.reshape(m, self.n)

    def _batch(self, names: np.ndarray, query: np.ndarray, at: np.ndarray, idf: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, n, row = len(names), self.n, self.row[at]
        short = np.flatnonzero(row < 0)
        scores = self._short(m, query[short], at[short], idf[short])
        long = np.flatnonzero(row >= 0)
        weights = np.zeros((m, len(self.dense)), dtype=np.float32)
        weights[query[long], row[long]] = idf[long]
        floor = floors[names]
        # dense lists are optional: blocks are scored with them if the block maxima of all lists reach the floor
        bound = np.maximum.reduceat(scores, self.edges, axis=1) + (weights @ self.dense_best) * (1 + self.off)
        able = bound >= np.maximum(floor - _SLACK, 1e-300)[:, None]
        asked = np.flatnonzero(able.any(axis=1))
        if not len(asked):
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0)
        blocks = np.flatnonzero(able.any(axis=0))
        a, z = int(self.edges[blocks[0]]), int(self.edges[blocks[-1]] + self.widths[blocks[-1]])
        found = weights[asked] @ self.dense[:, a:z]
        found += scores[:, a:z] if len(asked) == m else scores[asked, a:z]
        # what a document has at most: its sum here and what single precision may have lost
        least = np.maximum((floor[asked] - _SLACK) * (1 - 2 * self.off), 1e-30).astype(np.float32)
        good = found >= least[:, None]
        many = np.flatnonzero(np.count_nonzero(good, axis=1) > k)
        if len(many):
            kth = np.partition(found[many], z - a - k, axis=1)[:, z - a - k].astype(np.float64) * (1 - self.off)
            floors[names[asked[many]]] = np.maximum(floor[asked[many]], kth)
            good[many] = found[many] >= np.maximum(least[many], ((kth - _SLACK) * (1 - 2 * self.off)).astype(np.float32))[:, None]
        q, doc = np.nonzero(good)
        q, doc = asked[q], doc + a
        total = scores[q, doc]
        # exact scores of candidates
        begin = np.searchsorted(query[long], np.arange(m + 1))
        lo, hi = begin[q], begin[q + 1]
        if len(lo) and len(self.key):
            one = np.repeat(np.arange(len(q)), hi - lo)
            term = long[_spread(lo, hi)]
            key = row[term].astype(np.int64) * n + doc[one]
            place = np.searchsorted(self.key, key)
            place[place == len(self.key)] = 0
            hit = self.key[place] == key
            total = total + np.bincount(one[hit], weights=self.exact[place[hit]] * idf[term[hit]], minlength=len(q))
        ok = total >= np.maximum(floors[names[q]] - _SLACK, 1e-300)
        return names[q[ok]], doc[ok] + self.first, total[ok]


class Shard:
    """One shard's groups of documents, ready for queries."""

    def __init__(self, b: pa.RecordBatch, mean: float, block: int = BLOCK):
        ids = b.column("doc_ids").flatten()
        sizes = np.frombuffer(b.column("sizes")[0].as_py(), dtype=np.int32)
        self.ids, self.nameless = ids.fill_null(-1).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        self.terms, self.starts = b.column("terms").flatten().to_numpy(), b.column("starts").flatten().to_numpy()
        self.doc = doc = np.frombuffer(b.column("posting")[0].as_py(), dtype=np.int32)
        tf = np.frombuffer(b.column("tf")[0].as_py(), dtype=np.int32).astype(np.float64)
        norm = K1 * (1 - B + B * sizes / mean) if mean else np.full(len(sizes), K1)
        self.impact = impact = tf * (K1 + 1) / (tf + norm[doc])
        term = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.starts))
        edges = b.column("groups").flatten().to_numpy().astype(np.int64) if "groups" in b.schema.names else np.array([0, len(self.ids)])
        group = np.searchsorted(edges, np.arange(len(self.ids)), side="right").astype(np.int16)[doc]
        order = np.argsort(group, kind="stable") if len(edges) > 2 else np.arange(len(doc))
        cuts = np.searchsorted(group[order], np.arange(1, len(edges) + 1))
        self.groups = []
        for g, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            mine, first = order[a:z], int(edges[g])
            self.groups.append(_Group(first, int(edges[g + 1]) - first, term[mine], doc[mine] - first, impact[mine], len(self.terms), block))

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term's list, -1 where there is none."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def search(self, query: np.ndarray, at: np.ndarray, idf: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As of its groups, of all of them."""
        parts = [x for g in self.groups for x in g.search(query, at, idf, floors, k) if len(x[0])]
        if not parts:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0)
        query, doc, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        ok = score >= floors[query] - _SLACK
        return query[ok], doc[ok], score[ok]

    def best(self, terms: np.ndarray, idf: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that may be among the k best of this shard and reach the floor, all ties included."""
        at = self.lists(terms)
        hit = np.flatnonzero(at >= 0)
        _, docs, scores = self.search(np.zeros(len(hit), dtype=np.int64), at[hit], idf[hit], np.array([floor]), k)
        return docs, scores


def _top(query: np.ndarray, ids: np.ndarray, nameless: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The rows of the k best of each query, query by query, ties by the smaller id (null first)."""
    order = np.lexsort((ids, ~nameless, -scores, query))
    query = query[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=np.int64)
    return order[np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)])) < k]


def _search(shards: DataFrame, queries: tuple, n: int, mean: float, k: int) -> DataFrame:
    """The k best of each partition's shards for each query that reach its floor; one list a query over all its shards.

    ``queries`` has their ids, the bounds of their terms, these as numbers into a list of terms, the list with its document
    frequencies, and the floors.
    """
    shared = shards.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, bounds, number, terms, df, floors = shared.value
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        floor = floors.copy()
        held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0))
        for b in slices(batches, 1):
            shard = None  # the last one goes before the next is made
            shard = Shard(b, mean, BLOCK)
            lists, found = shard.lists(terms).astype(np.int32), []
            for first in range(0, len(qids), QUERIES):  # few at once, for their terms' sake
                edges = bounds[first : first + QUERIES + 1]
                mine = number[edges[0] : edges[-1]]
                at = lists[mine]
                hit = np.flatnonzero(at >= 0)
                query = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[hit]
                names, docs, scores = shard.search(query, at[hit], idf[mine[hit]], floor[first : first + QUERIES], k)
                found.append((names + first, docs, scores))
            if not found:
                break
            names, docs, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            rounded = np.round(scores, PLACES)
            ok = rounded >= floors[names]
            names, docs, rounded = names[ok], docs[ok], rounded[ok]
            if not len(names):
                continue
            held = tuple(np.r_[x, y] for x, y in zip(held, (names, shard.ids[docs], shard.nameless[docs], rounded), strict=True))
            best = _top(*held, k)
            held = tuple(x[best] for x in held)
            last = np.flatnonzero(np.r_[held[0][1:] != held[0][:-1], True])
            full = last[np.diff(np.r_[-1, last]) == k]
            floor[held[0][full]] = np.maximum(floor[held[0][full]], held[3][full])
        for first in range(0, len(held[0]), 40960):
            names, ids, nameless, scores = (x[first : first + 40960] for x in held)
            yield pa.RecordBatch.from_arrays([pa.array(qids[names]), pa.array(ids, mask=nameless), pa.array(scores)], ["query_id", "doc_id", "score"])

    return shards.mapInArrow(search, "query_id long, doc_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first()))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def top_documents(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents for each query, fewer if fewer share a term with it.

    ``queries`` has qid and text.  A query is the set of its words (A-Z lower-cased, apart by ASCII white space); rows
    of one qid are one query; one without words, or without qid, has no result.  Scores are rounded to six places
    and ties go to the smaller doc_id (null first); repeated documents are documents of their own.  A document
    that is also a query is found like any other.  Null and blank texts count as documents of length 0.
    Other columns are ignored; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    index = stage(build_index(docs), "index")
    n, total, shards = (x or 0 for x in index.agg(F.sum(F.size("doc_ids")), F.sum("words"), F.count("*")).first())
    mean = total / n if n else 0.0
    df = index.select(F.explode(F.arrays_zip("terms", F.slice("starts", 1, F.size("terms")).alias("lo"), F.slice("starts", 2, F.size("terms")).alias("hi"))).alias("t"))
    df = df.groupBy(F.col("t.terms").alias("term")).agg(F.sum(F.col("t.hi") - F.col("t.lo")).alias("df"))
    asked = stage(query_terms(queries.where("qid is not null").select(F.col("qid").cast("long").alias("qid"), "text")).join(df, "term"), "query-terms")
    rounds = -(-asked.count() // ROUND_TERMS)
    # a shard's phase: how often PHASE divides its hash, among as many powers as there are shards for
    powers = 0
    while PHASE ** (powers + 1) <= shards:
        powers += 1
    level = sum((F.pmod(F.xxhash64("shard"), F.lit(PHASE**p)) == 0).cast("int") for p in range(1, powers + 1)) if powers else F.lit(0)
    results = None
    for r in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == r).toArrow()
        qid, term, dfs = (part.column(c).to_numpy() for c in ("qid", "term", "df"))
        order = np.lexsort((term, qid))
        qid, (terms, one, number) = qid[order], np.unique(term[order], return_index=True, return_inverse=True)
        dfs = dfs[order][one].astype(np.float64)
        first = np.flatnonzero(np.r_[True, qid[1:] != qid[:-1]]) if len(qid) else np.zeros(0, dtype=np.int64)
        floors, so_far = np.full(len(first), -np.inf), None
        for phase in range(powers, -1, -1):
            chosen = index.where(level == phase) if powers else index
            found = stage(_search(chosen, (qid[first], np.r_[first, len(qid)], number.astype(np.int32), terms, dfs, floors), n, mean, k), "found")
            so_far = found if so_far is None else so_far.unionByName(found)
            if phase:  # the k-th best so far: one number a query of this round
                least = _ranked(so_far, k).where(F.col("rank") == k).select("query_id", "score").toArrow()
                at = np.searchsorted(qid[first], least.column("query_id").to_numpy())
                floors[at] = least.column("score").to_numpy()
        results = so_far if results is None else results.unionByName(so_far)
    if results is None:
        results = spark.createDataFrame([], "query_id long, doc_id long, score double")
    return _ranked(results, k).select("query_id", "rank", "doc_id", "score")


def op7_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100, among all rows of documents.

    Null and empty texts are documents of length 0, found by no query and asking nothing; texts of any length are indexed whole;
    ties go to the smaller doc_id; repeated rows are found each; null ids are found but ask nothing; other columns are ignored.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return top_documents(docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "text"))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*)::double AS f FROM w GROUP BY ALL),
dl AS (SELECT doc_id, sum(f) AS n FROM tf GROUP BY doc_id),
g AS (SELECT (SELECT count(*) FROM documents)::double AS n, (SELECT count(*) FROM w)::double / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT t, count(*)::double AS d FROM tf GROUP BY t),
s AS (
  SELECT q.doc_id AS query_id, tf.doc_id, round(sum(ln(1 + (g.n - d + 0.5) / (d + 0.5)) * tf.f * 2.2 / (tf.f + 1.2 * (0.25 + 0.75 * dl.n / mean))), 6) AS score
  FROM tf q JOIN df USING (t) JOIN tf ON tf.t = q.t JOIN dl ON dl.doc_id = tf.doc_id, g WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""
