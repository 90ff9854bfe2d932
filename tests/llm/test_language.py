import math
import random
import zlib

from taleframe.llm.language import LONGEST, fit_languages, identify_languages, known_language_documents, op1_language_id, train_languages, training_sample

SYLLABLES = {"aa": ["the", "ing", "and", "er"], "bb": ["ich", "und", "ß", "ver"], "cc": ["éau", "le", "que", "oi"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rejected string"


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join(word(rng, lang) for _ in range(rng.randint(3, 60))), lang, "s", 1, "clash"))
    return out


def test_held_out_accuracy_and_edges(spark):
    train, held = spark.createDataFrame(rows(200, 1), SCHEMA), rows(60, 2)
    model = train_languages(train, rows=150)
    edge = [(None, "the and the ing", None, None, None, None), (900, None, "aa", None, None, None), (901, "", "aa", None, None, None), (902, " 12 -- 3!", "bb", None, None, None), (1, held[1][1], "aa", "s", 1, ""), (903, held[0][1] + " " + held[0][1] * 800, "aa", "s", 1, "")]
    got = identify_languages(spark.createDataFrame(held + edge, SCHEMA), model).collect()
    assert len(got) == len(held) + len(edge)
    right = [r["lang_pred"] == lang for r, (_, _, lang, *_) in zip(sorted([r for r in got if r["doc_id"] is not None and r["doc_id"] < 60][:60], key=lambda r: r["doc_id"]), held, strict=False)]
    assert sum(right) >= 55
    by = {r["doc_id"]: r for r in got}
    for i in (900, 901, 902):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[None]["lang_pred"] == "aa" and by[903]["lang_pred"] == held[0][2]
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] == "und" or r["lang_pred"] in SYLLABLES) for r in got)


def test_stage_keeps_clean_documents(spark):
    docs = spark.createDataFrame([*rows(120, 3), (500, "   ", "aa", None, 3, None), (501, "the ing and the er and", None, None, 5, None)], SCHEMA)
    got = {r["doc_id"]: r["lang"] for r in known_language_documents(docs, train_languages(docs, rows=100)).collect()}
    assert 500 not in got and got[501] == "aa" and len(got) >= 119


def test_nothing_learned(spark):
    model = fit_languages([], [])
    docs = spark.createDataFrame([(1, "text", None, None, None, None)], SCHEMA)
    assert [(r["lang_pred"], r["score"]) for r in identify_languages(docs, model).collect()] == [("und", 0.0)]
    assert train_languages(docs.limit(0)).languages == [] and identify_languages(docs.limit(0), model).count() == 0
    assert fit_languages(["only one"], ["xx"]).probabilities([b"anything"])[0, 0] == 1.0


def test_query_never_looks_at_held_out_labels(spark, tmp_path):
    plain = rows(240, 5)
    plain += [(None, "the and the ing er", "bb", None, None, None), (400, plain[0][1] * 20_000, None, None, None, None), (401, None, "aa", None, None, None)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    spark.createDataFrame(plain, SCHEMA).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    turned = [(i, t, "cc" if held(i) else lang, s, n, x) for i, t, lang, s, n, x in plain]
    spark.createDataFrame(turned, SCHEMA).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    one, two = (sorted((str(r["doc_id"]), r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in op1_language_id(spark, str(tmp_path / d)).collect()) for d in "ab")
    assert one == two and len(one) == len(plain)
    got = {i: (h, p) for i, h, p, _ in one}
    assert all(got[str(i)][0] == held(i) for i, *_ in plain)
    right = [got[str(i)][1] == lang for i, _, lang, *_ in plain[:240] if held(i)]
    assert sum(right) >= 0.9 * len(right) and got["400"][1] == plain[0][2] and got["401"][1] == "und"


def test_long_texts_keep_their_language(spark):
    long = [("fr", f"le chat {i} est sur la table et il mange une pomme " * 600) for i in range(30)]
    short = [("en", f"the cat {i} sat on the table and ate an apple") for i in range(30)]
    odd = [("de", " " * 50_000 + f"die Katze {i}") for i in range(5)]
    df = spark.createDataFrame(long + short + odd, "lang string, text string")
    texts, labels = training_sample(df)
    assert sorted(set(labels)) == ["de", "en", "fr"] and max(map(len, texts)) <= LONGEST and all(any(c.isalpha() for c in t) for t in texts)
    model = fit_languages(texts, labels)
    rows = spark.createDataFrame([(1, "il mange une pomme sur la table et le chat est la " * 900), (2, "the apple sat on the cat")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in identify_languages(rows, model).collect()} == {1: "fr", 2: "en"}


def test_probabilities_equal_a_plain_loop():
    texts = [f"the cat {i} sat" for i in range(12)] + [f"le chat {i} mange" for i in range(12)]
    model = fit_languages(texts, ["en"] * 12 + ["fr"] * 12)
    said = [t.encode() for t in ("le chat sat", "the mange", "x", "", "le chat sat")]
    for t, row in zip(said, model.probabilities(said), strict=True):
        z, padded = [0.0, 0.0], t + b" " * 8
        for place in range(len(t) + 1):
            h = 0
            for order in range(4):
                h = (h * 0x01000193 + padded[place + order] + 1) % 2**32
                bucket = ((h ^ h >> 15) * 0x9E3779B1 % 2**32) >> 16
                z = [v + float(w) for v, w in zip(z, model.table[bucket], strict=True)]
        z = [(v / (4 * (len(t) + 1)) + b) / model.temperature for v, b in zip(z, model.bias, strict=True)]
        e = [math.exp(v - max(z)) for v in z]
        assert all(abs(v / sum(e) - p) < 1e-6 for v, p in zip(e, row, strict=True))
