import random
import re

import pytest

from taleframe.llm import minhash
from taleframe.llm.minhash import deduplicated, distinct_documents, near_duplicates


def brute(rows: list[tuple], words: int, percent: int) -> dict:
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ünder", "É", "x y"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for g in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))] + (passage if g < 3 else [])
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 9)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n", "  "]).join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in w))
    out += ["", None, " \t\n", "one", "ONE", "one two", "one  two ", "É", "é", out[0], out[0], "z" * 5000, "z" * 5000 + "y"]
    out += [" ".join(passage), "long " * 3000, "long " * 2900]
    out += [out[1].upper() if k % 2 else out[1].lower() for k in range(40)]
    order = list(range(len(out)))
    rng.shuffle(order)
    return list(zip(order, out, strict=True))


@pytest.mark.parametrize(("words", "percent", "chunk"), [(2, 80, 512), (2, 80, 4), (5, 80, 512), (3, 50, 7)])
def test_equals_brute_force(spark, rows, words, percent, chunk, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, u string")
    bands = {80: 40, 50: 200}[percent]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, words, percent, bands=bands, rows=5 if percent == 80 else 3).collect()}
    assert got == brute(rows, words, percent)


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(4, "a b c d e f", None, None, 1), (4, "a b c d e f", None, None, 1), (None, "a b c d e f", None, None, 1), (9, "A b c d e f", None, None, 1), (7, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect())
    assert got == [("4", 2, 4, True), ("4", 2, 4, True), ("7", 0, 7, True), ("9", 2, 4, False), ("None", 2, None, True)]
    assert sorted(str(r["doc_id"]) for r in deduplicated(docs).collect()) == ["4", "4", "7", "None"]
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(1, 7))
def test_a_partition_of_one_short_text(spark, n):
    text = " ".join("abcdef"[:n])
    docs = spark.createDataFrame([(1, text), (2, text.upper())], "doc_id long, text string").repartitionByRange(2, "doc_id")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect())
    assert got == [(1, max(n - 4, 1), 1), (2, max(n - 4, 1), 1)]


def test_one_row_of_each_group_stays(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "a b c d e f"
    rows = [(None, text, None, None, 1), (9, text.upper(), None, None, 1), (4, text, None, None, 1), (4, text, None, None, 1), (9, "g h i j k l", None, None, 1), (None, "m n o p q r", None, None, 1), (7, None, None, None, None), (7, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in distinct_documents(docs).collect())
    assert got == [("4", text), ("7", ""), ("7", ""), ("9", "g h i j k l"), ("None", "m n o p q r")]
    assert distinct_documents(docs.limit(0)).count() == 0


def test_many_batches_in_a_partition(spark):
    rows = [(i, f"a{i % 700} b c d e f{i % 700} g h") for i in range(1400)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), words=5).collect()
    assert len(got) == 1400 and all(r["component_id"] == r["doc_id"] % 700 for r in got)
