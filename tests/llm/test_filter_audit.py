import random
import re
from itertools import permutations

import duckdb

from taleframe.llm import filter_audit

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def fails(i, text, least):
    words = SPACE.findall(text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": i is not None and least.get(text, i) < i,
    }


def plain(docs, labels):
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = [(s or "", fails(i, t or "", least), any(x == i is not None and q == 1 for x, q, _ in labels), any(x == i is not None and b == 1 for x, _, b in labels)) for i, s, t in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own, removed_by = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone, stay = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                redundant = sum(r[1][f] and any(r[1][g] for g in order[: k - 1]) for r in own)
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                out[part, "".join(order), k] = [len(stay), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                removed_by[f] += len(gone)
                left = stay
        for order in permutations("ABCDE"):
            for k, f in enumerate(order, 1):
                out[part, "".join(order), k].append(removed_by[f])
    return out


def fixture():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "Äé\x0b word\x0cword", "a | b", "UPPER CASE", " ".join(["same"] * 300), " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i % 100}" for i in range(200)), " ".join(f"w{i % 99}" for i in range(200)), "x" * 98 + "AB", "x" * 97 + "ABC", "é" * 49 + "A", " " * 250, "x " * 50000]
    docs = [(rng.choice([None, *range(40)]), rng.choice([None, "", "hot", "hot", "s1"]), rng.choice(texts)) for _ in range(150)]
    docs += [(7, "hot", texts[8])] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 40, 2)] + [(4, 1, 1), (None, 1, 1)]
    return docs, labels


def test_equals_a_plain_audit_and_its_sql(spark, tmp_path):
    docs, labels = fixture()
    frame = spark.createDataFrame([(*d, 1, True) for d in docs], "doc_id long, source string, text string, words int, c boolean")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = filter_audit.op11_filter_audit(spark, str(tmp_path)).collect()
    got = {tuple(r)[:3]: list(r)[3:] for r in rows}
    assert got == plain(docs, labels) and len(rows) == len(got)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    names = [c[0] for c in con.sql(f"DESCRIBE ({filter_audit.OP11_SQL})").fetchall()]
    assert names == frame.sparkSession.createDataFrame(rows).columns
    assert {tuple(r[:3]): list(r[3:]) for r in con.sql(filter_audit.OP11_SQL).fetchall()} == got


def test_words_are_grouped_where_they_are_read(spark, monkeypatch):
    rows = [(i, text) for i, text in enumerate(["a b a", "", " ", "\x0bx\x0cx\r\ny ", "é\u00a0é é", "w " * 5000, "\x1cz z", "last"])]
    frame = spark.createDataFrame(rows, "row long, text string").repartition(2)
    plan = filter_audit.word_counts(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(row") < plan.index("MapInArrow") and plan.count("Exchange") == 2
    want = {(i, len(SPACE.findall(t)), len(set(SPACE.findall(t)))) for i, t in rows if SPACE.findall(t)}
    for size in (1, 5, 1 << 22):
        monkeypatch.setattr(filter_audit, "BATCH_BYTES", size)
        assert {tuple(r) for r in filter_audit.word_counts(frame).collect()} == want


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert filter_audit.op11_filter_audit(spark, str(tmp_path)).count() == 0
