from qalake.llm import registry, url_filter

from ..oracle import compare, connect


def test_query_and_fragment_are_judged(spark):
    rows = [
        (1, "https://x.org/search?q=porn"), (2, "https://x.org/go#casino"), (3, "https://x.org?Q=XXX"), (4, "https://x.org/free?a=1#WIN"), (5, "https://x.org/?q=pornography"),
        (6, "https://x.org/free?a=free#free"), (7, "https://www.example.com/en/?q=porn"), (8, "https://x.org/?utm_source=a&page=2#top"), (9, "https://x.org/p\u00e9?q=sex"),
    ]
    got = {r.page_id: (r.verdict, r.n_strict, r.n_soft) for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {
        1: ("block", 1, 0), 2: ("block", 1, 0), 3: ("block", 1, 0), 4: ("block", 0, 2), 5: ("allow", 0, 0),
        6: ("allow", 0, 1), 7: ("allow", 1, 0), 8: ("allow", 0, 0), 9: ("block", 1, 0),
    }


def test_verdicts_on_the_given_pages_are_the_sql_ones(spark):
    assert compare(spark, connect(), url_filter.op4_url_filter, registry.ORACLES["op4_url_filter"]) > 0


def test_the_vocabulary_decides_where_no_rule_fits(spark):
    """Forms of one term count once; ties, repeats, long urls and clashing columns."""
    rows = [
        (1, "https://free-bets.x.org/"), (2, "https://bet-bets-betting.x.org/"), (3, "https://gratis.x.org/apuestas"), (4, "https://spam-farm.x.org/1"), (5, "https://ads-track.x.org"),
        (6, "https://x.org/" + "a/" * 50_000 + "?free#poker"), (7, "https://x.org/" + "free/" * 50_000), (8, ""), (None, "https://x.org/win-win"), (1, "https://free-bets.x.org/"),
        (9, "https://x.org/freebets"), (10, "kostenlos.x.org/wetten"), (11, "https://example.com/en/free-bets"), (12, "https://www.example.com/en/free-bets"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "1 as path", "2 as verdict", "3 as rule", "4 as u", "5 as r")
    got = sorted((str(r.page_id), r.verdict, r.n_soft) for r in url_filter.url_filter(pages).collect())
    assert got == sorted([
        ("1", "block", 2), ("1", "block", 2), ("2", "allow", 1), ("3", "block", 2), ("4", "block", 2), ("5", "block", 2), ("6", "block", 2), ("7", "allow", 1), ("8", "allow", 0),
        ("None", "allow", 1), ("9", "allow", 0), ("10", "block", 2), ("11", "block", 2), ("12", "allow", 2),
    ])
    longest = url_filter.url_filter(pages, rules=(("org", "/", "allow"), ("x.org", "/", "block"), ("x.org", "/free", "allow"))).filter("page_id in (6, 7)").collect()
    assert {r.page_id: (r.rule, r.verdict) for r in longest} == {6: ("x.org/", "block"), 7: ("x.org/free", "allow")}
