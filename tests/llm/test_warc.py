import hashlib

from taleframe.llm import warc

RECORD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
LONG = "é" * 700
BODIES = [
    (1, "http://a/", "plain"), (2, None, None), (3, "", ""), (4, "http://b/WARC/1.0", LONG), (5, "x\r\nWARC/1.0\r\n", LONG), (6, "c", LONG),
    (7, "d", RECORD * 3), (8, "e", f"WARC/1.0\r\n{RECORD}WARC/1.0\r\nContent-Length: 99999\r\n\r\nx"), (9, "f", "\r\n\r\nWARC/1.0\r\n" * 40), (10, "g", "WARC/1.0\r\nContent-Length: 7\r\n\r\n"),
    (11, "h", "y" * 999), (12, "i", "y" * 999), (13, "j", "z" * 1000), (14, "k", "z" * 1000), (14, "k", "z" * 1000), (None, "l", "z" * 1000), (-3, "m", "ends\r\n\r\n"), (15, "n", "\r\n\r"), (16, "o", "WARC/1.0\r"),
    (17, "p", ("w" * 3000 + RECORD) * 30), (18, "q", "long " * 40000), (None, "r", "short"), (2**62, "s", RECORD + LONG),
]


def plain(rows):
    top = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000:
            top.setdefault(body, []).append(i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        most = max((x for x in top.get(body, []) if x is not None), default=None)
        revisit = most is not None and most != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", most if revisit else None))
    return sorted(out, key=str)


def result(spark, folder):
    return sorted((tuple(r) for r in warc.op13_warc(spark, str(folder)).collect()), key=str)


def test_round_trip_in_small_and_large_blocks(spark, tmp_path):
    rows = BODIES * 2
    spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, value string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    for size in ("128m", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert result(spark, tmp_path) == plain(rows)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_shuffled_when_many_are_shared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    spark.createDataFrame(BODIES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert result(spark, tmp_path) == plain(BODIES)


def test_broken_and_foreign_files(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes((RECORD * 4).encode())
    (tmp_path / "b.warc").write_bytes((RECORD + RECORD.replace("5", "50") + RECORD).encode())
    (tmp_path / "c.warc").write_bytes(("junk " + RECORD).encode())
    found = {}
    for r in warc.read_warc(spark, str(tmp_path)).collect():
        found.setdefault(r["file"][-6:], []).append(r)
    assert sorted(found) == ["a.warc", "b.warc"]
    assert len(found["a.warc"]) == 4 and [r["last"] for r in sorted(found["a.warc"], key=lambda r: r["at"])] == [False, False, False, True]
    assert not any(r["last"] for r in found["b.warc"])


def test_pointers_double_over_many_blocks(spark):
    chain = [("f", i // 2, 10 + 7 * i, 17 + 7 * i) for i in range(100)] + [("f", i // 2, 12 + 7 * i, 19 + 7 * i) for i in range(99)] + [("g", 0, 10, 999), ("g", 0, 20, 30)]
    got = {tuple(r) for r in warc.reachable(spark.createDataFrame(chain, "file string, block long, at long, next long")).collect()}
    assert got == {("f", 10 + 7 * i) for i in range(100)} | {("g", 10)}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert result(spark, tmp_path) == []
