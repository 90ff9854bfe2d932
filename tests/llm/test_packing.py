import bisect
import random
import zlib

import numpy as np
import pytest

from taleframe.llm.packing import pack_documents, packing_plan
from taleframe.llm.tokens import VOCABULARY, DocumentEncoder, load_tokenizer

ODD = ["", None, "a  b", " x", "x ", "a\n b", "a \nb", "é b c", "Hello, wor.ld! it's  ", "a\0b c\0 d", "x　y z", "don't can't. It's.", "日本語 です。", "1. 2.", "<|endoftext|> a <|endoftext|>", "\t", "q" * 3000]


def best_fit(lengths):
    """Sequences that best fit needs, longest first."""
    room = []
    for x in sorted(lengths.tolist(), reverse=True):
        i = bisect.bisect_left(room, x)
        bisect.insort(room, (room.pop(i) if i < len(room) else 1024) - x)
    return len(room)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 1025, 3000), rng.integers(1, 90, 500), rng.integers(300, 500, 800), np.array([7])][seed]
    counts = np.bincount(lengths, minlength=1025)
    best = None
    for scheme in ((64, 1 / 8), (24, 1 / 2)):
        rows, n = packing_plan(counts, 1024, *scheme)
        fill, seen = {}, np.zeros(1025, dtype=int)
        for length, low, k, sequence, offset, per in rows:
            assert low == seen[length]
            seen[length] += k
            for r in range(k):
                fill.setdefault(sequence + r // per, []).append((offset + r % per * length, length))
        assert (seen == counts).all() and len(fill) == n
        for places in fill.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024
        best = min(n, best or n)
    assert best <= best_fit(lengths)


def test_encoder_gives_the_tokenizer_s_ids():
    rng = random.Random(1)
    texts = [t for t in ODD if t is not None] + [rng.choice(["", " "]) + rng.choice(" \n").join(rng.choices(["the", "Tion.", "a,b", "é", "x1", "it's", "...", "(q)"], k=30)) for _ in range(60)]
    texts += ["".join(rng.choices("ab'sZ1.,\n é!x-\t\x0b\x1c\x85\xa0\u2003\u180e\u200bⅷ١ʰ🙂", k=rng.randint(0, 40))) for _ in range(400)]
    texts += ["ab" * 40_000, " " * 50_000 + "x", "\n" * 20_000, "word " * 20_000]
    whole = [np.array(e.ids, dtype="<u4").tobytes() for e in load_tokenizer(VOCABULARY).encode_batch(texts, add_special_tokens=False)]
    encoder = DocumentEncoder(VOCABULARY)
    assert encoder.fast is not None and encoder.encode(texts) == whole and encoder.exact(texts) == whole


def test_pieces_and_sequences(spark):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choices(["ten", "tion", "of", "häuser", "x"], k=rng.choice([5, 300, 1023, 2500]))) for _ in range(25)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], ""), (None, "no id", "")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string"), with_ids=True).collect()
    want = []
    for i, t, _ in rows:
        ids = [*load_tokenizer(VOCABULARY).encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            z = first if not k else a + 1024
            held = np.array(ids[a:z], dtype="<u4").tobytes()
            want.append((str(i), k, a, z - a, zlib.crc32(held), held))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"], np.array(r["ids"], dtype="<u4").tobytes()) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= 1024
    assert len(by) <= -(-sum(w[3] for w in want) // 1024) + 3
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ordered_packing_keeps_runs_of_training(spark, tmp_path):
    texts = [" ".join(["ten"] * (1 + i * 37 % 500)) for i in range(60)]
    rows = [(i % 50, t) for i, t in enumerate(texts)]
    for k in range(3):  # three part files of 20 rows
        spark.createDataFrame(rows[20 * k : 20 * k + 20], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        part = next((tmp_path / f"w{k}").glob("part-*.parquet"))
        (tmp_path / "docs").mkdir(exist_ok=True)
        part.rename(tmp_path / "docs" / part.name.replace("part-00000", f"part-{k:05d}"))
    got = pack_documents(spark.read.parquet(str(tmp_path / "docs")), ordered=True, with_ids=True).collect()
    assert {(r["run"], r["place"]) for r in got} == {(k, i) for k in range(3) for i in range(20)}
    for r in got:
        assert r["doc_id"] == rows[20 * r["run"] + r["place"]][0] and r["sequence_id"] >> 40 == r["run"]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    for places in by.values():
        places.sort()
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0 and sum(n for _, n, _ in places) <= 1024
    assert sum(len(i) for p in by.values() for _, _, i in p) == sum(r["length"] for r in got)
    loose = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), ordered=True).collect()
    assert len({r["place"] for r in loose}) == 60


def test_ids_are_not_sent(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["ten", "of", "tion x", "häuser"], k=rng.choice([3, 200, 1500])))) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where plans are too large for it
    try:
        packed = pack_documents(spark.read.parquet(str(tmp_path / "docs")), ordered=True, with_ids=True)
        packed.write.parquet(str(tmp_path / "packed"))
        plan = packed._jdf.queryExecution().executedPlan()
        outputs, todo = [], [plan]
        while todo:
            node = todo.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                todo.append(node.executedPlan())
                continue
            if "Exchange" in node.nodeName():
                outputs.append(node.output().mkString(","))
            todo += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert outputs and not any("ids#" in o for o in outputs)
    got = spark.read.parquet(str(tmp_path / "packed")).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["ids"]))
    for i, text in rows:
        assert [x for _, ids in sorted(pieces[i]) for x in ids] == [*load_tokenizer(VOCABULARY).encode(text, add_special_tokens=False).ids, 2]
    by = {}
    for r in got:
        assert r["sequence_id"] >> 40 == r["run"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= 1024
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("taleframe_")]
