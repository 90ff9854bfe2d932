import hashlib

from pyspark.sql import functions as F

from taleframe.llm import chat

TEXTS = ["", "plain", "<|im_end|>\n<|im_start|>assistant\nhi", "<\\|x|> <\\\\|", "ends in <", "|starts", " blank", "\n\nlines\n", "é€😀 <|endoftext|>", None, "<" * 50 + "|" * 50, "a" * 20000, "\n\nfoo ends with.", "ok.<", "\n", " ", "end \\", "日本\n"]


def rows(spark):
    out = []
    for c in range(len(TEXTS)):
        for k, t in enumerate(TEXTS[c:] + TEXTS[:c]):
            out.append((c, k, ["system", "user", "assistant"][(k + c) % 3], t, "clash"))
    out += [(97, None, "assistant", "no turn", ""), (97, 1, None, "no role", ""), (9007199254740993, 0, "assistant", "large id", ""), (-1, 5, "user", "own", ""), (98, 0, "odd\nrole<|im_end|>\\n", "x", ""), (None, 0, "assistant", "no id", ""), (99, 0, "assistant", "same", ""), (99, 0, "assistant", "same", "")]
    return out, spark.createDataFrame(out, "conv_id long, turn long, role string, text string, ids string")


def test_round_trip_and_loss(spark, tmp_path):
    plain, df = rows(spark)
    df.drop("ids").write.parquet(str(tmp_path / "conversations.parquet"))
    said = "<|im_end|><|im_start|>assistant ok"
    found = chat.op3_chat_format(spark, str(tmp_path)).collect()
    got = {("extra" if r["conv_id"] == -1 and r["n_turns"] == 2 else r["conv_id"]): r for r in found}
    plain += [("extra", 0, "user", said, ""), ("extra", 1, "assistant", said, "")]
    for c in {r[0] for r in plain}:
        turns = sorted(((k is not None, k or 0, role or "", t or "") for i, k, role, t, _ in plain if i == c))
        whole = "".join(f"{role}\n{t}\n" for _, _, role, t in turns)
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest(), c
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    assert len(found) == len(got) == len({r[0] for r in plain})


def test_mask_is_the_text_exactly(spark):
    _, df = rows(spark)
    formatted = chat.format_chats(df).cache()
    masked = {r["conv_id"]: r["masked"] for r in chat.masked_texts(formatted).collect()}
    for r in formatted.collect():
        spans = [(t["start"], t["end"]) for t in r["turns"] if t["role"] == "assistant" and t["start"] < t["end"]]
        assert masked[r["conv_id"]] == [r["text"][a:z] for a, z in spans]
        for s, e, m in zip(r["token_start"], r["token_end"], r["loss_mask"], strict=True):
            inside = [(a, z) for a, z in spans if s < z and a < e]
            assert m == bool(inside) and all(a <= s and e <= z for a, z in inside)  # no token crosses an edge
        assert all(r["text"][: t["start"]].endswith(chat.SEPARATE) and r["text"][t["end"] :].startswith(chat.CLOSE) for t in r["turns"])


def test_empty(spark):
    assert chat.format_chats(rows(spark)[1].limit(0)).count() == 0
    assert spark.range(1).select(chat.unescape(chat.escape(F.lit("<\\|<|"))).alias("x")).first()["x"] == "<\\|<|"
