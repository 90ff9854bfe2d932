import random

from taleframe.llm.url_filter import RULES, filter_urls, op9_url_filter, rule_table

URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1", "http://www.example.com/en/x?y#z", "http://a.www.example.com/en/", "http://example.com", "http://example.com?x=/en/", "http://example.com#/en/",
        "http://x.net/es/1", "http://x.net/fr", "http://net/fr/1", "http://notexample.com/en/", "http://xcom/", "ftp://a://b/c", "http://example.com//en/", "http://example.com/EN/", "http://example.com:80/en/", "http://u@example.com/en/", "http://" + "a." * 2000 + "net/es/", "http://b.net/" + "es/" * 2000, "http://é.com/è"]


def plain(url, rules):
    at = (url or "").find("://")
    rest = (url or "")[at + 3 :] if at >= 0 else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def check(spark, rules, urls):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, rule_table(spark, rules)).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_fixed_rules(spark):
    check(spark, RULES, URLS + URLS[:6])


def test_other_rules(spark):
    rng = random.Random(5)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net"], ["/", "", "/p", "/p/q", "/p/q/", "/pq"]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.6]
    urls = [f"http://{rng.choice(['', 'z.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'r', '/r', '?p'])}" for _ in range(120)]
    check(spark, rules, urls)


def test_empty_and_repeats(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://x.net/es/"), (1, "http://x.net/es/"), (None, None)], "page_id long, url string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted((str(r["page_id"]), r["verdict"]) for r in op9_url_filter(spark, str(tmp_path)).collect()) == [("1", "block"), ("1", "block"), ("None", "allow")]
    assert filter_urls(df.limit(0), rule_table(spark)).count() == 0
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r["verdict"] for r in filter_urls(df, none).collect()} == {"allow"}
