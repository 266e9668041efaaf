import random

from episcope.llm import urls
from episcope.llm.queries import URL_RULES
from tests.llm.helpers import rows

SCHEMA = "page_id LONG, url STRING, html STRING"


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def judged(spark, found, rules):
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(found)], SCHEMA)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, urls.rule_table(spark, rules)).collect()}


def test_production_rules_on_odd_urls(spark):
    odd = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1", "https://a.example.org/en/1x?q", "http://example.org/en/2", "http://badexample.org/es/",
           "x://y://z.org/", "http://org/", "http://org", "ftp://a.com/fr/#x", "http://a.com/de/", "http://a.com/DE/", "http://a.com?x=/de/", "http://a..com/fr/",
           "http://É.org/é", "http://u:p@b.com:80/de/", "http://com/de/" + "y" * 50_000, "http://" + "a." * 2000 + "com/fr/", "http://a.com\n/de/", "http://a.org/\nx"]
    found = judged(spark, odd * 2, URL_RULES)
    assert len(found) == 2 * len(odd)
    for k, u in enumerate(odd * 2):
        assert found[k] == plain(u, URL_RULES), u


def test_more_rules_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_BROADCAST_RULES", 2)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ["http://a.example.org/es/x", "http://com/fr/", "http://b.com/de/", "x://net/", None]
        pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(found)], SCHEMA)
        out = urls.judge_urls(pages, urls.rule_table(spark, URL_RULES))
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()} == {k: plain(u, URL_RULES) for k, u in enumerate(found)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_random_rules_against_brute_force(spark):
    r = random.Random(4)
    labels, paths = ["a", "b", "com", "org"], ["/", "/x", "/x/", "/x/y", ""]
    rules = {(".".join(r.choices(labels, k=r.randint(1, 3))), r.choice(paths)): r.choice(["allow", "block"]) for _ in range(25)}
    rules = [(h, p, a) for (h, p), a in rules.items()]
    found = [f"http://{'.'.join(r.choices(labels, k=r.randint(1, 5)))}{r.choice(paths)}{r.choice(['', 'z', '?q', '#f'])}" for _ in range(600)]
    got = judged(spark, found, rules)
    assert all(got[k] == plain(u, rules) for k, u in enumerate(found))


def test_rule_listed_both_ways_blocks_and_no_rules_allow(spark):
    both = [("a.com", "/", "allow"), ("a.com", "/", "block")]
    assert judged(spark, ["http://a.com/"], both)[0][2:] == ("a.com/", "block")
    assert judged(spark, ["http://a.com/", None], []) == {0: ("a.com", "/", None, "allow"), 1: ("", "", None, "allow")}


def test_rows_columns_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "h", "mine", 5), (1, "http://a.org/", "h", "mine", 5), (None, None, None, None, None)],
                                  "page_id LONG, url STRING, html STRING, host STRING, row_id INT")
    out = urls.judge_urls(pages, urls.rule_table(spark, URL_RULES))
    assert out.columns == ["page_id", "url", "html", "row_id", "host", "path", "rule", "verdict"]
    assert rows(out) == [(None,) * 4 + ("", "", None, "allow")] + [(1, "http://a.org/", "h", 5, "a.org", "/", "org/", "allow")] * 2
    assert urls.judge_urls(pages.limit(0), urls.rule_table(spark, URL_RULES)).count() == 0


def test_main_path_is_native(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    plan = urls.judge_urls(pages, urls.rule_table(spark, URL_RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "BroadcastHashJoin" in plan
