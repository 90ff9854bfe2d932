import hashlib
import re

from taleframe.llm.pii import detect_pii, op8_pii, redact, redact_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string"
TEXTS = [
    "mail a.b+c@mail.example.com, x@y no@dot a@b.c@d.ef m_x@q.rs a@b.com_x@d.ef",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5 0001.02.3.255 1.2.3 9.9.9.9999999999999999999999",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 1234567890123 3782 822463 10005",
    "phone +1 (017) 555-7713 and +12 34 +123456789012345678 +1.234.567.8901.",
    "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 but not GB82WEST12345698765433",
    "é€😀 a@b.cd 😀 8.8.8.8", "", None, "no data here", "1 " * 3000, "+" * 500, "a" * 20000 + "@b.cd", "4111111111111111 4111111111111111", "x 4111111111111111@b.cd +1.2.3.4.5.6.7.8.9.0 1.2.3.4@c.de",
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    }
    for rank, (kind, (p, ok)) in enumerate(kinds.items()):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(p, t) if ok(m[0])]
    return sorted(out)


def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], None, None, None, "")], SCHEMA)


def test_base_equals_plain_rules(spark, tmp_path):
    docs(spark).drop("spans").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op8_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in [*enumerate(TEXTS), (None, TEXTS[0])]:
        want = base(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, _, k, z in want).encode()).hexdigest(), i
        for kind in ("email", "ip", "card", "phone"):
            assert got[i][f"n_{kind}"] == sum(k == kind for _, _, k, _ in want)
        assert {f"{k}:{a}:{z}" for a, _, k, z in want} <= set(got[i]["spans"].split(",")) | {""}
    assert got[4]["spans"].count("iban") == 2


def test_scores_follow_context(spark):
    d = spark.createDataFrame([(1, "my credit card 4111111111111111"), (2, "token 4111111111111111"), (3, "x 4111111111111111")], "doc_id long, text string")
    s = {r["doc_id"]: r["spans"][0]["score"] for r in detect_pii(d).collect()}
    assert s[1] > s[3] > s[2]


def test_redaction(spark):
    got = {r["doc_id"]: r for r in redact_documents(docs(spark)).collect()}
    assert got[5]["text"] == "é€😀 [EMAIL] 😀 [IP]" and got[5]["n_chars"] == len(got[5]["text"])
    assert got[7]["text"] is None and got[6]["text"] == "" and got[8]["text"] == TEXTS[8] and got[12]["text"] in ("[CARD] [CARD]", TEXTS[12])
    assert redact(detect_pii(docs(spark).limit(0))).count() == 0


HOSTILE = {
    "labels": "a@b" + ".c" * 100_000,
    "addresses": "x@y.zz " * 100_000,
    "dots": "1." * 200_000,
    "digits": "1 " * 500_000,
    "phones": "+1" + " " * 300_000 + "+2" * 100_000,
    "nested": ".".join(["1"] * 60_000) + "@b.cd",
    "hex": "a" * 100_000 + "0" * 100_000,
    "long": "é word " * 1_500_000 + "a@b.cd",
}


def test_hostile_texts_cost_what_they_are_long(spark):
    d = spark.createDataFrame([(k, t) for k, t in HOSTILE.items()], "doc_id string, text string").repartition(4)
    found = {r["doc_id"]: r for r in redact(detect_pii(d)).selectExpr("doc_id", "size(spans) n", "try_element_at(spans, -1) last", "length(text) as size", "right(text, 20) as tail", "left(text, 30) as head").collect()}
    assert found["labels"]["n"] == 1 and found["labels"]["last"]["end"] == len(HOSTILE["labels"]) and found["labels"]["head"] == "[EMAIL]"
    assert found["addresses"]["n"] == 100_000 and found["addresses"]["size"] == 8 * 100_000 and found["addresses"]["head"] == "[EMAIL] [EMAIL] [EMAIL] [EMAIL"[:30]
    assert found["nested"]["n"] == 1 + 15_000 and found["nested"]["head"] == "[EMAIL]"
    assert found["long"]["n"] == 1 and found["long"]["tail"].endswith("word [EMAIL]") and found["long"]["last"]["start"] == len(HOSTILE["long"]) - 6
    for k in ("dots", "nested"):
        assert base(HOSTILE[k][:4000])  # the plain rules agree on shorter ones
    short = spark.createDataFrame([(k, t[:4001]) for k, t in HOSTILE.items()], "doc_id string, text string")
    for r in detect_pii(short).collect():
        want = base(r["text"])
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] in ("email", "ip", "card", "phone")] == [(a, k, z) for a, _, k, z in want]


def test_context_decides_on_added_kinds(spark):
    rows = [(1, "token = " + "a1" * 20), (2, "see " + "a1" * 20), (3, "AKIA" + "B2" * 8), (4, "commit sha " + "a1" * 20), (5, "key " + "1" * 40)]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in detect_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["secret"], 2: [], 3: ["secret"], 4: [], 5: []}
