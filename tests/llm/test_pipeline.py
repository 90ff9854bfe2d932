import random
import re

import corpus_pipeline
from taleframe.llm.tokens import VOCABULARY, load_tokenizer
from test_minhash import brute
from test_mixing import targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = {"en": ["the", "and", "thing", "over", "er"], "fr": ["le", "éau", "que", "oiseau", "des"]}
    rows = []
    for i in range(150):
        lang = "en" if i % 3 else "fr"
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(8, 90))), lang, f"s{i % 4}" if i % 2 else "s0", 0))
    rows += [(200 + k, rows[k][1], rows[k][2], "s1", 0) for k in range(5)] + [(210, None, "en", "s1", 0), (211, "  ", "en", None, 0), (212, "the thing mails the.one@example.com and the others over there", None, None, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in seen["language"]} == {r[0] for r in rows} - {210, 211}
    groups = brute([(r["doc_id"], r["text"]) for r in seen["language"]], 5, 80)
    assert sorted(r["doc_id"] for r in seen["near_duplicates"]) == sorted(i for i, (_, c) in groups.items() if i == c)
    clean = {r["doc_id"]: r["text"] for r in seen["personal_data"]}
    assert clean[212] == "the thing mails [EMAIL] and the others over there" and len(clean) == len(seen["near_duplicates"])
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = {}, {}
    for r in seen["personal_data"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + count(r["text"])
    for r in seen["mixture"]:
        assert clean[r["doc_id"]] == r["text"]
        taken[r["source"]] = taken.get(r["source"], 0) + count(r["text"])
    for s, t in targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 90
    n = sum(len(load_tokenizer(VOCABULARY).encode(r["text"], add_special_tokens=False).ids) + 1 for r in seen["mixture"])
    assert sum(r["length"] for r in seen["packing"]) == n
    assert sorted(r["doc_id"] for r in seen["packing"] if r["piece"] == 0) == sorted(r["doc_id"] for r in seen["mixture"])
    assert all(len(r["ids"]) == r["length"] for r in seen["packing"])
    # training order: the sequences of a part file come from its rows only, and copies differ in their place
    assert len({(r["run"], r["place"]) for r in seen["packing"]}) == len(seen["mixture"])
    assert all(r["sequence_id"] >> 40 == r["run"] for r in seen["packing"])


def test_run_on_awkward_tables(spark, tmp_path):
    def run(name, rows, schema=SCHEMA):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        return corpus_pipeline.run(spark, str(tmp_path / name)).collect()

    assert run("empty", []) == []
    assert run("nulls", [(None, None, None, None, None), (1, "", "en", "s", 0), (None, "  ", None, None, None)]) == []
    text = " ".join(f"the thing{i % 7} and over it" for i in range(40))
    extra = [(i, f"{text} {chr(97 + i) * 3} " + "word " * (5 * i), "en", "s" if i % 2 else None, None, "clash", i, "x") for i in range(12)]
    extra += [(3, extra[3][1], "en", "s", None, "clash", 1, "x"), (None, "le éau que oiseau des " * 30, "fr", None, None, "", 0, ""), (20, "the thing and over it " * 5000, "en", "s", 0, "", 0, "")]
    got = run("extra", extra, SCHEMA + ", row string, size long, place string")
    assert got and all(len(r["ids"]) == r["length"] <= 1024 for r in got)
    assert {r["doc_id"] for r in got} <= {*range(12), 20, None}
