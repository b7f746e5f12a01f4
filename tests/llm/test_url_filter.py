import random

import duckdb

from tidewake.llm import url_filter
from tidewake.llm import url_filter as uf


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")


def judged(spark, urls, **how):
    return {r["page_id"]: r for r in uf.judge_urls(pages(spark, urls), **how).collect()}


def test_split_and_rules(spark):
    cases = [
        ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
        ("x://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
        ("http://z.org?q=/fr/", "z.org", "", None, "allow"),
        ("http://z.org/fr/ü://b", "z.org", "/fr/ü://b", "org/fr/", "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://É.NET/", "É.net", "/", "net/", "block"),
    ]
    got = judged(spark, [c[0] for c in cases])
    for i, c in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == c[1:], c


def test_template_verdicts(spark):
    """Unlabelled paths take the purity of their own template, never that of an unlike sibling."""
    rules = [("block", "a.com", "/bad/9"), ("allow", "a.com", "/good/9")]
    urls = [f"http://a.com/bad/9{i}" for i in range(30)] + [f"http://a.com/good/9{i}" for i in range(30)]
    urls += ["http://a.com/bad/1", "http://a.com/good/1", "http://a.com/new/1", "http://b.com/bad/1"]
    got = judged(spark, urls, rules=rules)
    assert [got[60 + i]["verdict"] for i in range(4)] == ["block", "allow", "allow", "allow"]
    assert got[60]["template"] == "/bad/*" and got[60]["branch"] != got[61]["branch"]


def test_similar_branches_merge(spark):
    rules = [("block", "a.com", f"/{k}/9") for k in ("p", "q")]
    urls = [f"http://a.com/{k}/9{i}" for k in ("p", "q") for i in range(9)] + ["http://a.com/p/1", "http://a.com/new/1"]
    got = judged(spark, urls, rules=rules)
    assert got[0]["branch"] == got[9]["branch"] == "/*/*" and got[18]["verdict"] == "block" and got[19]["verdict"] == "allow"


def test_rare_words_become_wildcards(spark):
    urls = [f"http://a.com/{'abcdefghij'[i // 100 % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i % 10]}/x.html" for i in range(1000)]
    got = judged(spark, urls)
    assert {r["template"] for r in got.values()} == {"/*/x.html"}


def test_deep_paths_and_empty(spark):
    got = judged(spark, ["http://a.com/" + "d/" * 3000 + "1", "http://a.com/a/b/c/d/e/f", "http://a.com//", "http://a.com/a/b/c/d/e/f"])
    assert len(got) == 4 and all(r["verdict"] == "allow" for r in got.values())
    assert uf.judge_urls(pages(spark, [])).count() == 0


def test_branches_merge_at_every_level(spark):
    """Thin blocked branches deep in the tree are pooled; the mixed one beside them is not."""
    rules = [("block", "a.com", f"/shop/item/{k}/buy/9") for k in "pqr"] + [("allow", "a.com", "/shop/item/s/buy/9")]
    urls = [f"http://a.com/shop/item/{k}/buy/9{i}" for k in "pqrs" for i in range(7)] + ["http://a.com/shop/item/p/buy/1", "http://a.com/shop/item/s/buy/1", "http://a.com/shop/item/t/buy/1"]
    got = judged(spark, urls, rules=rules)
    assert got[0]["branch"] == got[7]["branch"] == got[14]["branch"] == "/shop/item/*/buy/*" != got[21]["branch"]
    assert [got[i]["verdict"] for i in (28, 29, 30)] == ["block", "allow", "allow"]
    one = judged(spark, urls[:7] + urls[28:29], rules=rules)  # seven labels alone do not reach the threshold
    assert one[7]["verdict"] == "allow"


def test_wildcards_at_any_depth(spark):
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    got = judged(spark, [f"http://a.com/1/x/y/z/v/{w}/{i % 3}" for i, w in enumerate(words * 2)] + ["http://a.com/1/x/y/z/v"], rare=0.02)
    assert {r["template"] for r in got.values()} == {"/*/x/y/z/v/*/*", "/*/x/y/z/v"}


def test_matches_sql(spark):
    """Rules that label many branches at several levels, against the SQL."""
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdef") for _ in range(n))
    rules = [("block", "net", f"/{a}/") for a in "abc"] + [("allow", "net", f"/{a}/") for a in "de"] + [("block", "x.org", f"/a/{b}/") for b in "abcd"]
    urls = []
    for _ in range(1500):
        k = rnd.randint(0, 5)
        urls.append(f"http://{rnd.choice(['x.net', 'y.net', 'x.org'])}/" + "/".join(rnd.choice([word(1), word(1), word(3), str(rnd.randint(0, 99)), "p.html"]) for _ in range(k)))
    urls += [None, "", "x://", "http://x.net", "http://x.net/", "http://x.net//a/"]
    df = pages(spark, urls)
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    how = {"fanout": 8, "rare": 0.05, "threshold": 0.7}
    want = sorted(con.sql(uf.judge_sql(rules, **how)).fetchall(), key=str)
    got = sorted((tuple(r) for r in uf.judge_urls(df, rules=rules, **how).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == want and sum(r[4] == "block" and r[3] is None for r in got) > 0


def test_native_plan(spark):
    plan = uf.judge_urls(pages(spark, ["http://a.com/1"]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_columns_of_any_name_are_kept(spark):
    names = ["host", "template", "branch", "purity", "_r", "_ruled", "_ruled_", "n", "labelled", "blocked"]
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.org/y/1")], "page_id bigint, url string")
    got = url_filter.judge_urls(pages.selectExpr("*", *[f"'{n}' as {n}" for n in names])).orderBy("page_id").collect()
    assert [(r["host"], r["verdict"], r["_r"], r["_ruled"], r["n"]) for r in got] == [("a.net", "block", "_r", "_ruled", "n"), ("b.org", "allow", "_r", "_ruled", "n")]
