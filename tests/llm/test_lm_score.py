import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taleframe.llm.common import fold
from taleframe.llm import mixing_model as mm
from taleframe.llm import lm_score
from taleframe.llm.lm_score import learn_model, op2_lm_score, score_documents, spell_words, split_words
from taleframe.llm.mixing_model import CONTEXTS, HEAD, NEAR_SLOTS, SLOTS, START, Mixer, WordMixer, add_slots, node_counts, word_events

SCHEMA = "doc_id long, text string, lang string, score double"


def test_bytes_of_a_context_add_up_to_one():
    tables = np.zeros((len(CONTEXTS), SLOTS, 2), dtype=np.float32)
    event, _ = word_events([b"banana", b"band", b"can"] * 5)
    add_slots(tables, event, np.ones((len(event), 2), dtype=np.int64))
    model = Mixer()
    model.learn(tables, event, np.zeros(len(event), dtype=np.int64), 0.05)
    for context in (event[3] >> 8, 0, 0x6261):
        cost = model.bits(tables, (context << 8) | np.arange(256), 2)
        assert np.allclose((2.0**-cost).sum(axis=0), 1, atol=1e-4)


@pytest.mark.parametrize("group", ["lang", None])
def test_base_is_exact_and_score_learns(spark, group):
    rng = random.Random(4)
    words = {"a": [f"st{k % 7}er{k}" for k in range(40)], "b": [f"qu{k % 5}al{k}" for k in range(40)]}
    rows = []
    for i in range(260):
        lang = "ab"[i % 2]
        rows.append((i, " ".join(rng.choices(words[lang], weights=range(1, 41), k=rng.randint(1, 40))).capitalize(), lang if i % 5 else None, 0.0))
    rows += [(260, None, "a", 0.0), (261, "", None, 0.0), (262, "Ünseen wörd \t x" + "y" * 300, "a", 0.0), (None, "st1er1", "a", 0.0), (3, rows[3][1], "b", 0.0), (264, "x " * 5000, "b", 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = score_documents(docs, fold(F.col("doc_id"), 7) != 2, group).collect()
    assert len(got) == len(rows)
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter(w for i, t, *_ in rows if train(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in rows:
        w = tokens(t)
        want[i, train(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r["doc_id"], r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    held = [r for r in got if not r["train"] and r["doc_id"] is not None and r["doc_id"] < 260]
    # with classes of documents it beats one unigram table; without, texts drawn word by word leave nothing to gain
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * (1 if group else 1.06)


def test_no_training_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "some words", None, 0.0), (2, None, None, 0.0)], SCHEMA)
    got = {r["doc_id"]: r for r in score_documents(docs, F.lit(False)).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0.0 and got[1]["score"] < got[2]["score"] < 0
    assert score_documents(docs.limit(0), F.lit(True)).count() == 0


def test_ranks_have_one_code_each():
    rank = np.array([0, 1, 2, 3, 9, 1000, HEAD - 1, HEAD])
    path = {int(r): [] for r in rank}
    for _, which, node, bit in mm.rank_decisions(rank):
        for r, n, b in zip(rank[which].tolist(), node.tolist(), bit.tolist(), strict=True):
            path[r].append((n, b))
    assert path == {int(r): plain_path(int(r)) for r in rank}
    model, counts = WordMixer(), np.zeros(HEAD + 1)
    counts[:50] = 7
    common = node_counts(counts)
    near = np.zeros((2, NEAR_SLOTS, 2), dtype=np.float32)
    every = np.arange(HEAD + 1)
    p = 2.0 ** -model.cost(model.prepared(common, common[None], near), every, every * 0 + 3, every * 0 + 4, every * 0).astype(np.float64)
    assert 0.98 < p.sum() < 1.0001


def plain_path(rank):
    n = rank.bit_length()
    out = [((1 << j) | (n >> (5 - j)), (n >> (4 - j)) & 1) for j in range(5)]
    return out + [(32 + (1 << (n - 1)) + (rank >> (n - 1 - i)), (rank >> (n - 2 - i)) & 1) for i in range(n - 1)]


def test_score_is_the_plain_loop_s(spark, tmp_path):
    rng = random.Random(9)
    words = {"a": [f"st{k % 7}er{k}" for k in range(30)], "b": [f"qu{k % 5}al{k}" for k in range(30)]}
    rows = [(i, " ".join(rng.choices(words["ab"[i % 2]], weights=range(1, 31), k=rng.randint(1, 30))) + f" only{i}", "ab"[i % 2] if i % 7 else None, 0.0) for i in range(80)]
    rows += [(90, None, "a", 0.0), (91, "é unseen! St1er1", None, 0.0), (92, rows[3][1] + " " + rows[4][1], "a", 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    train = fold(F.col("doc_id"), 7) != 2
    m = learn_model(docs, train)
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    in_train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    labels = [x for x, _ in sorted(Counter(r[2] for r in rows if in_train(r[0]) and r[2]).items(), key=lambda x: (-x[1], x[0]))]
    klass = lambda x: labels.index(x) if x in labels else len(labels)
    counts, by = Counter(), [Counter() for _ in range(len(labels) + 1)]
    for i, t, lang, _ in rows:
        if in_train(i):
            counts.update(tokens(t))
            by[klass(lang)].update(tokens(t))
    order = sorted(counts, key=lambda w: (-counts[w], w))
    assert m.ranks.words == order
    rank = {w: k for k, w in enumerate(order, start=1)}
    # counts at nodes and after the last words
    node, node_by, near = Counter(), [Counter() for _ in by], [Counter(), Counter()]

    def slot(k, one, two, at):
        return int(mm._slot(mm.near_hashes(np.array([one]), np.array([two]))[k], np.array([at]), mm.NEAR_BITS)[0])

    for i, t, lang, _ in rows:
        if in_train(i):
            seen = [START, START]
            for w in tokens(t):
                for at, bit in plain_path(rank[w]):
                    node[at, bit] += 1
                    node_by[klass(lang)][at, bit] += 1
                    for k in range(2):
                        near[k][slot(k, seen[-1], seen[-2], at), bit] += 1
                seen.append(rank[w])
    assert all(m.tables.value[0][at, bit] == n for (at, bit), n in node.items()) and m.tables.value[0].sum() == sum(node.values())
    for k in range(2):
        assert all(m.tables.value[2][k][at, bit] == n for (at, bit), n in near[k].items()) and m.tables.value[2][k].sum() == sum(near[k].values())
    sizes = [sum(c.values()) for c in by]

    def bits_of(n0, n1, i, j):
        return m.words.weights[i, min(int(n0 + n1 + 1).bit_length() - 1, 11), j] * math.log((n1 + 0.4) / (n0 + 0.4))

    def plain_score(t):
        seen, total = [START, START], 0.0
        lean = [math.log((s + 1) / (sum(sizes) + len(sizes))) for s in sizes]
        for w in tokens(t):
            c, r = max(range(len(lean)), key=lambda k: lean[k]), rank.get(w, 0)
            for j, (at, bit) in enumerate(plain_path(r)):
                z = bits_of(node[at, 0], node[at, 1], 0, j) + bits_of(node_by[c][at, 0], node_by[c][at, 1], 1, j)
                for k in range(2):
                    s = slot(k, seen[-1], seen[-2], at)
                    z += bits_of(near[k][s, 0], near[k][s, 1], 2 + k, j)
                cell = m.words.cells[j, round((min(max(z, -8), 8) + 8) * 2)]
                z = min(max((z + math.log(cell[1] / cell[0])) / 2, -16), 16)
                total += math.log2(1 + math.exp(-z if bit else z))
            if r:
                lean = [x + math.log((by[k][w] + 0.5) / (sizes[k] + 0.5 * (len(order) + 1))) for k, x in enumerate(lean)]
            else:
                total += spelled(w, c)
            seen.append(r)
        return -total * math.log10(2)

    letters = [Counter() for _ in CONTEXTS]

    def spell_slots(w, c):
        data = w + b" "
        for p, byte in enumerate(data):
            for q in range(8):
                at, bit = (1 << q) | (byte >> (8 - q)), (byte >> (7 - q)) & 1
                where = []
                for i, _ in enumerate(CONTEXTS):
                    context = sum(data[p - k] << (8 * (k - 1)) for k in range(1, 6) if p >= k)
                    where.append(int(mm._slot(mm._hash(np.array([context]), i, np.array([c])), np.array([at]))[0]))
                yield q, bit, where

    for k, c in enumerate(by):
        for w in c:
            for _, bit, where in spell_slots(w, k):
                for i, s in enumerate(where):
                    letters[i][s, bit] += 1

    def spelled(w, c):
        total = 0.0
        for q, bit, where in spell_slots(w, c):
            z = 0.0
            for i, s in enumerate(where):
                n0, n1 = letters[i][s, 0], letters[i][s, 1]
                z += m.letters.weights[i, min(int(n0 + n1 + 1).bit_length() - 1, 11), q] * math.log((n1 + 0.4) / (n0 + 0.4))
            cell = m.letters.cells[q, round((min(max(z, -8), 8) + 8) * 2)]
            z = min(max((z + math.log(cell[1] / cell[0])) / 2, -16), 16)
            total += math.log2(1 + math.exp(-z if bit else z))
        return total

    got = {r["doc_id"]: r for r in op2_lm_score(spark, str(tmp_path)).collect()}
    texts = {r[0]: r[1] for r in rows}
    for i in (0, 3, 5, 17, 40, 90, 91, 92):
        assert got[i]["held_out"] == (not in_train(i))
        assert abs(got[i]["score"] - plain_score(texts[i])) < 2e-2 + 1e-3 * abs(got[i]["score"]), i
    # the order of the words counts
    back = spark.createDataFrame([*rows, (1000, " ".join(reversed(rows[3][1].split())), "b", 0.0)], SCHEMA)
    again = {r["doc_id"]: r["score"] for r in score_documents(back, F.col("doc_id") < 100).collect()}
    assert abs(again[1000] - again[3]) > 0.5


def test_equal_events_are_counted_and_learned_as_one(monkeypatch):
    event, _ = word_events([b"banana", b"band", b"can", b"nab"] * 500)
    cls, hashed, plain = np.arange(len(event)) // 17 % 2, [], mm._hash
    distinct = len(set(zip(event.tolist(), cls.tolist(), strict=True)))
    monkeypatch.setattr(mm, "_hash", lambda context, which, c: hashed.append(len(context)) or plain(context, which, c))
    tables, model = np.zeros((len(CONTEXTS), SLOTS, 2), dtype=np.float32), Mixer()
    add_slots(tables, event, np.eye(2, dtype=np.int64)[cls])
    model.learn(tables, event, cls, 0.05)
    assert len(hashed) == 2 * len(CONTEXTS) and max(hashed) <= distinct < len(event) / 50
    # the plain way, event by event
    want = np.zeros_like(tables)
    for b, node, bit in mm._decisions(event):
        for i in range(len(CONTEXTS)):
            np.add.at(want[i], (mm._slot(plain(event >> 8, i, cls), node), bit), 1)
    assert (tables == want).all()
    for b, node, bit in mm._decisions(event):
        z, inputs = np.zeros(len(event)), []
        for i in range(len(CONTEXTS)):
            n = want[i][mm._slot(plain(event >> 8, i, cls), node)]
            n[np.arange(len(event)), bit] -= 1
            st = np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4))
            level = np.minimum(np.log2(n.sum(axis=1) + 1).astype(int), mm.LEVELS - 1)
            z += 0.3 * st
            inputs.append((st, level))
        wrong = (1 / (1 + np.exp(-z)) - bit) / len(event)
        for i, (st, level) in enumerate(inputs):
            g = np.bincount(level, weights=wrong * st, minlength=mm.LEVELS)
            assert np.allclose(model.weights[i, :, b], 0.3 - 0.05 * g / np.sqrt(1e-4 + g * g), atol=1e-4)
    assert model.cells.sum() == pytest.approx(Mixer().cells.sum() + 8 * len(event))


def test_words_learn_without_their_own_counts():
    rng = np.random.default_rng(6)
    rank = rng.choice([0, 1, 2, 3, 40, 900, HEAD], 3000, p=[0.1, 0.4, 0.2, 0.1, 0.1, 0.09, 0.01]).astype(np.int32)
    one, two, cls, own = np.r_[np.int32(START), rank[:-1]], np.r_[np.int32(START), np.int32(START), rank[:-2]], np.arange(3000) // 100 % 2, np.arange(3000) // 70 % 2
    path = list(mm.ordered_decisions(rank[(order := mm.longest_first(rank))]))
    back = {int(w): [] for w in order}
    for _, m, node, bit in path:
        for w, n, x in zip(order[:m].tolist(), node.tolist(), bit.tolist(), strict=True):
            back[w].append((n, x))
    assert all(back[w] == plain_path(int(rank[w])) for w in back)
    counts = [np.bincount(rank[own == k], minlength=HEAD + 1) for k in range(2)]
    common, by_class = node_counts(sum(counts)), np.stack([node_counts(c) for c in counts])
    near = np.zeros((2, NEAR_SLOTS, 2), dtype=np.float32)
    mm.add_near(near, rank, one, two)
    model = WordMixer()
    model.learn(model.left_out(common, by_class, near), rank, one, two, cls, own, 0.05)
    hashes = mm.near_hashes(one, two)
    for j, which, node, bit in mm.rank_decisions(rank):
        which = np.arange(len(rank))[which]
        z, inputs = np.zeros(len(which)), []
        for i in range(4):
            held = common[node] if i == 0 else by_class[cls[which], node] if i == 1 else near[i - 2][mm._slot(hashes[i - 2][which], node, mm.NEAR_BITS)]
            n = held.copy()
            n[np.arange(len(which)), bit] -= (cls == own)[which] if i == 1 else 1
            st = np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4))
            level = np.minimum(np.log2(n.sum(axis=1) + 1).astype(int), mm.LEVELS - 1)
            z += 0.3 * st
            inputs.append((st, level))
        wrong = (1 / (1 + np.exp(-z)) - bit) / len(which)
        for i, (st, level) in enumerate(inputs):
            g = np.bincount(level, weights=wrong * st, minlength=mm.LEVELS)
            assert np.allclose(model.weights[i, :, j], 0.3 - 0.05 * g / np.sqrt(1e-4 + g * g), atol=1e-4), (i, j)


def test_words_of_texts_are_the_plain_split_s(monkeypatch):
    odd = ["", None, "  ", "A", " a\x0b\x0cB\r\nc\x1c\x1dD\x85e \u3000Z ", "É Ünd É und", "x" * 300 + "\tY", "\n\n", "the end", "The THE\x00the"]
    texts = [random.Random(k).choice(odd) for k in range(200)] + odd
    for size in (1, 40, 1 << 24):
        monkeypatch.setattr(lm_score, "PIECE", size)
        got, pieces = [], 0
        for p in split_words(pa.array(texts, pa.string())):
            assert p.at == len(got) and len(set(p.distinct.to_pylist())) == len(p.distinct)
            words = [p.distinct[i].as_py().encode() for i in p.word.tolist()]
            for n in p.sizes.tolist():
                got.append(words[:n])
                words = words[n:]
            assert not words
            pieces += 1
        assert got == [(t or "").encode().lower().split() + [b""] for t in texts]
        assert pieces > 20 if size < 100 else pieces == 1
    assert not list(split_words(pa.array([], pa.string())))


def test_spellings_that_batches_share_are_costed_once(spark):
    words = [f"st{k % 40}er{k % 7}" for k in range(4000)]
    model, asked = Mixer(), []
    model.bits_from = lambda guesses, event, classes: asked.append(event) or Mixer().bits_from(guesses, event, classes)
    tables = np.zeros((len(CONTEXTS), SLOTS, 2), dtype=np.float32)

    class Words:
        """A frame that hands its function over instead of running it on executors."""

        columns, schema = ["token"], spark.createDataFrame([], "token string").schema

        def mapInArrow(self, function, schema):  # noqa: N802
            return function

    class Shared:
        value = tables

    spell = spell_words(Words(), Shared(), model, 2)
    got = pa.Table.from_batches(spell(pa.RecordBatch.from_arrays([pa.array(words[a : a + 100])], ["token"]) for a in range(0, len(words), 100)))
    event, starts = word_events([w.encode() for w in words])
    # batches of the input have most events in common, and each is costed once for all of them
    assert sum(map(len, asked)) == len(np.unique(event))
    assert got["token"].to_pylist() == words
    plain = Mixer().bits(tables, event, 2)
    for k in range(2):
        assert np.allclose(got[f"s_{k}"].to_numpy(), np.add.reduceat(plain[:, k], starts))
