"""URL verdicts: the rules by hand, the classifier against plain Python and held-out hosts."""

from weftline.llm import url_filter
from weftline.llm.url_filter import BUCKETS, judge, labelled_urls, train


def judged(spark, urls, schema="page_id bigint, url string"):
    rows = judge(spark.createDataFrame(urls, schema), labelled_urls(spark)).collect()
    return {r.page_id: r for r in rows}


def test_rules_and_parts(spark):
    urls = [
        "http://Example.ORG/es/1",
        "https://a.example.org/en/12?x=/y",
        "http://example.org/en/2#z",
        "http://b.com/fr/",
        "http://b.com/de/9",
        "http://b.com/defg",
        "http://notexample.org/es/1",
        "http://org",
        "http://www.com?x://y.org/",
        "no scheme",
        None,
        "",
        "x://ÄB.org/p://q",
        "http://" + "a" * 100_000 + ".net/" + "é" * 100_000,
    ]
    got = judged(spark, list(enumerate(urls)))
    parts = {i: (r.host, r.path, r.rule) for i, r in got.items()}
    assert [parts[i] for i in range(13)] == [
        ("example.org", "/es/1", "example.org/es/"),
        ("a.example.org", "/en/12", "example.org/en/1"),
        ("example.org", "/en/2", "org/"),
        ("b.com", "/fr/", "com/fr/"),
        ("b.com", "/de/9", "com/de/"),
        ("b.com", "/defg", None),
        ("notexample.org", "/es/1", "org/"),
        ("org", "", None),
        ("www.com", "", None),
        ("", "", None),
        ("", "", None),
        ("", "", None),
        ("Äb.org", "/p://q", "org/"),
    ]
    assert [got[i].verdict for i in range(5)] == ["block", "allow", "allow", "allow", "block"]
    assert len(got) == 14 and all(r.verdict in ("allow", "block") for r in got.values())


def test_rules_of_the_contract(spark):
    contract = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    assert dict(url_filter.RULES) == contract
    assert all(f"WHEN '{rule}' THEN '{kind}'" in url_filter.oracle() for rule, kind in contract.items())
    got = judged(spark, [(0, "http://example.org/en/12"), (1, "http://a.example.org/en/1"), (2, "http://example.org/en/2")])
    assert [got[i].verdict for i in range(3)] == ["block", "block", "allow"]


def test_weights_are_those_of_plain_python(spark):
    weights = train(labelled_urls(spark)).first().weights
    plain = url_filter._plain_weights()
    assert len(weights) == BUCKETS and all(abs(w - plain.get(i, 0)) <= 1 for i, w in enumerate(weights))


def test_held_out_hosts(spark):
    bad = ["adult-pills", "casino-bets", "free-win", "cheap-casino", "spam-ads", "win-casino"]
    good = ["gardening", "library-notes", "natural-history", "news", "theory", "books-review"]
    got = judged(spark, [(i, f"http://m.{x}.example.net/en/{i}") for i, x in enumerate(bad + good)])
    assert [got[i].verdict for i in range(12)] == ["block"] * 6 + ["allow"] * 6


def test_empty_and_repeated(spark):
    schema = "page_id bigint, url string, host string, weights int"
    assert judge(spark.createDataFrame([], schema), labelled_urls(spark)).collect() == []
    none = labelled_urls(spark).limit(0)
    rows = judge(spark.createDataFrame([(1, "http://casino.net/", "x", 1)] * 2 + [(None, None, None, None)], schema), none).collect()
    assert [r.verdict for r in rows] == ["allow"] * 3
