import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from taleframe.llm import bm25


def brute(docs, queries, k):
    tf = [Counter(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t in docs]
    n, mean = len(docs), sum(sum(c.values()) for c in tf) / max(1, len(docs))
    df = Counter(w for c in tf for w in c)
    out = []
    for q, t in queries:
        terms = set(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
        scored = []
        for (i, _), c in zip(docs, tf, strict=True):
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in terms if w in c)
            if s > 0:
                scored.append((-round(s, 6), i is not None, i or 0, i))
        out += [(q, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize(("shard", "block", "terms", "postings", "phase"), [(8192, 128, 10**6, 10**6, 8), (16, 4, 200, 10**6, 8), (16, 4, 10**6, 60, 2)])
def test_equals_brute_force(spark, shard, block, terms, postings, phase, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD", shard)
    monkeypatch.setattr(bm25, "BLOCK", block)
    monkeypatch.setattr(bm25, "ROUND_TERMS", terms)
    monkeypatch.setattr(bm25, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(bm25, "PHASE", phase)
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(200)]
    docs = [(i * 7 % 1009, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(200)], k=rng.randint(0, 60))).upper()) for i in range(160)]
    docs += [(2000, docs[3][1]), (2001, docs[3][1]), (2002, None), (2003, " \n"), (None, docs[3][1]), (2004, "only here"), (2004, "only here"), (2005, "w1 " * 4000)]
    queries = [d for d in docs if d[0] is not None and d[0] % 10 == 0] + [(9001, "unknown words"), (9002, None), (2001, docs[3][1])]
    queries = list(dict(queries).items())
    one = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, term string")
    asked = spark.createDataFrame(queries + [(None, "w1 w2")], "qid long, text string")
    got = [(r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in bm25.top_documents(one, asked, 5).collect()]
    want = brute(docs, queries, 5)
    assert sorted(x[:3] for x in got if x[2] is not None) == sorted(x[:3] for x in want if x[2] is not None)
    assert sorted((x[0], x[1], round(x[3], 5)) for x in got) == sorted((x[0], x[1], round(x[3], 5)) for x in want)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "qid long, text string")
    assert bm25.top_documents(none, some).count() == 0
    assert bm25.top_documents(some.withColumnRenamed("qid", "doc_id"), some.limit(0)).count() == 0


def shard_of(docs, block):
    found = list(bm25._term_counts(docs))
    term = np.concatenate([t for t, _ in found]).view(np.int64)
    doc = np.repeat(np.arange(len(found), dtype=np.int32), [len(t) for t, _ in found])
    tf, order = np.concatenate([n for _, n in found]).astype(np.int32), np.argsort(term, kind="stable")
    term, doc, tf = term[order], doc[order], tf[order]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    sizes = np.array([n.sum() for _, n in found], dtype=np.int32)
    row = [[list(range(len(docs)))], [sizes.tobytes()], [term[first]], [np.r_[first, len(term)].astype(np.int32)], [doc.tobytes()], [tf.tobytes()]]
    return bm25.Shard(pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["doc_ids", "sizes", "terms", "starts", "posting", "tf"]), float(sizes.mean()), block)


@pytest.mark.parametrize("block", [1, 4, 128])
def test_pruning_loses_nothing_above_the_floor(block):
    rng = random.Random(block)
    vocabulary, weights = [f"w{k}" for k in range(300)], [1 / (k + 1) for k in range(300)]
    docs = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 80))) for _ in range(500)]
    docs += docs[:20]
    shard = shard_of(docs, block)
    for _ in range(40):
        terms = np.unique(np.concatenate([t.view(np.int64) for t, _ in bm25._term_counts([" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))])]))
        idf = np.array([0.1 + rng.random() * 8 for _ in terms])
        whole = np.zeros(len(docs))
        for t, w in zip(terms, idf, strict=True):
            a = np.searchsorted(shard.terms, t)
            if a < len(shard.terms) and shard.terms[a] == t:
                whole[shard.doc[shard.starts[a] : shard.starts[a + 1]]] += w * shard.impact[shard.starts[a] : shard.starts[a + 1]]
        for floor in (-np.inf, *np.quantile(whole, [0.5, 0.9, 0.99]), whole.max(), whole.max() + 1):
            got = dict(zip(*(x.tolist() for x in shard.best(terms, idf, 10, floor)), strict=True))
            least = max(floor, np.sort(whole)[-10])
            want = {i: s for i, s in enumerate(whole) if s > 0 and s >= least}
            assert set(want) <= set(got) and all(abs(got[i] - whole[i]) < 1e-9 for i in got)


def of_two_languages(rng, n):
    """Texts of two languages that share one word; every third is of the second."""
    words = [[f"{x}{k}" for k in range(150)] for x in "ab"]
    return [" ".join(["both", *rng.choices(words[i % 3 == 2], [1 / (k + 3) for k in range(150)], k=rng.randint(5, 60))]) for i in range(n)]


def test_a_query_reads_no_documents_that_share_too_few_words(monkeypatch):
    monkeypatch.setattr(bm25, "GROUP", 100)
    texts = of_two_languages(random.Random(2), 900)
    row = bm25._shard(0, list(range(900)), list(bm25._term_counts(texts)))
    edges, ids = row.column("groups")[0].as_py(), row.column("doc_ids")[0].as_py()
    assert sorted(ids) == list(range(900))
    kinds = [{i % 3 == 2 for i in ids[a:z]} for a, z in zip(edges[:-1], edges[1:], strict=True)]
    assert {True} in kinds and {False} in kinds and all(len(k) == 1 for k in kinds)
    shard = bm25.Shard(row, 30.0, 16)
    at = np.flatnonzero(np.isin(shard.terms, next(bm25._term_counts([texts[2]]))[0].view(np.int64)))
    read = [len(list(g.search(np.zeros(len(at), dtype=np.int64), at, np.ones(len(at)), np.array([10.0]), 10))) for g in shard.groups]
    assert [bool(n) for n in read] == [True in k for k in kinds]


@pytest.mark.parametrize(("cells", "postings", "dense"), [(10**6, 10**6, 10**6), (2000, 50, 10**6), (10**6, 1, 0)])
def test_queries_searched_together_find_what_each_finds_alone(cells, postings, dense, monkeypatch):
    for name, value in (("GROUP", 100), ("BATCH_CELLS", cells), ("BATCH_POSTINGS", postings), ("DENSE_CELLS", dense)):
        monkeypatch.setattr(bm25, name, value)
    rng = random.Random(5)
    texts = of_two_languages(rng, 700)
    texts += texts[:30] + ["", None, "both"]
    row = bm25._shard(0, list(range(len(texts))), list(bm25._term_counts(texts)))
    shard = bm25.Shard(row, 30.0, 16)
    asked = [t.view(np.int64) for t, _ in bm25._term_counts(texts[:60])]
    weight = {t: 0.1 + rng.random() * 8 for a in asked for t in a.tolist()}
    whole = np.zeros((len(asked), len(texts)))
    for q, terms in enumerate(asked):
        for t in terms.tolist():
            a = int(np.searchsorted(shard.terms, t))
            here = slice(shard.starts[a], shard.starts[a + 1])
            whole[q, shard.doc[here]] += weight[t] * shard.impact[here]
    tenth = np.sort(whole, axis=1)[:, -10]
    for floors in (np.full(len(asked), -np.inf), tenth, tenth * np.array([rng.choice([0.3, 0.9, 1, 1.1]) for _ in asked])):
        query = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
        at = shard.lists(np.concatenate(asked))
        q, doc, score = shard.search(query, at, np.array([weight[t] for a in asked for t in a.tolist()]), floors.copy(), 10)
        got = {(i, d): s for i, d, s in zip(q.tolist(), doc.tolist(), score.tolist(), strict=True)}
        assert len(got) == len(q) and all(abs(whole[x] - s) < 1e-9 for x, s in got.items())
        least = np.maximum(floors, tenth)
        assert {(i, d) for i, d in zip(*np.nonzero(whole), strict=True) if whole[i, d] >= least[i]} <= set(got)


def test_many_like_documents_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(bm25, "QUERIES", 7)
    monkeypatch.setattr(bm25, "ROUND_TERMS", 400)
    docs = [(None if i % 50 == 7 else i, t) for i, t in enumerate(of_two_languages(random.Random(3), 2600))]
    queries = [d for d in docs if d[0] is not None and d[0] % 100 == 0]
    got = bm25.top_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "qid long, text string"), 4).collect()
    got, want = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in got), sorted(brute(docs, queries, 4))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-6)
