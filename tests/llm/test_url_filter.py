import duckdb
import pytest
from compare import check

from shoebox.llm import url_filter
from shoebox.llm.url_filter import judge_urls, parse_pattern, rule_index

URLS = [
    (0, None), (1, ""), (2, "no scheme"), (3, "http://"), (4, "https://A.Example.ORG/es/1?x#y"), (5, "https://example.org/en/12"), (6, "https://example.org"),
    (7, "x://y.com/fr/a"), (8, "x://com/de/"), (9, "x://xcom/de/"), (10, "http://ads.foo.net/a"), (11, "http://b.net/x.EXE"), (12, "http://b.net/x.exe?y"),
    (13, "http://blog.a.net/1?utm_source=feed"), (14, "http://a.net/1?utm_source=feed"), (15, "http://a.net/1?utm_source=feed"), (16, "a://b?c://d/e"),
    (17, "http://u:p@host:80/p" + "a" * 20_000), (18, "http://a.net/p\n?page=2&ref=x"), (18, "http://a.net/p\n?page=2&ref=x"), (None, "http://h.org/"),
]


def test_rules_and_patterns(spark):
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame([(*u, "h", "z") for u in URLS], "page_id bigint, url string, host string, rule string")).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("", "", None, "allow")
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[5].rule == "example.org/en/1" and got[6].rule is None and got[7].verdict == "allow" and got[8].verdict == "block" and got[9].rule is None
    assert [got[i].verdict for i in (10, 11, 12, 13, 14, 15)] == ["block", "block", "allow", "allow", "block", "block"]
    assert (got[16].host, got[16].path) == ("b", "") and got[17].host == "u:p@host:80" and got[None].rule == "org/"


def test_equals_running_every_rule(spark):
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", URLS)
    assert check(con, url_filter.check_sql(), judge_urls(spark.createDataFrame(URLS, "page_id bigint, url string"))) is None
    assert judge_urls(spark.createDataFrame([], "page_id bigint, url string")).collect() == []


@pytest.mark.parametrize("text, tokens", [("||ads.*^", ("ads",)), ("/banner/*.gif|", ("banner", "gif")), ("ad*count=", ()), ("?page=*&ref=x|", ("page", "ref", "x"))])
def test_tokens_are_those_every_match_holds(text, tokens):
    assert parse_pattern(text).tokens == tokens


def test_filed_under_the_rarest_token():
    rule = parse_pattern("/common/rare/")
    assert rule_index([rule], {"common": 9, "rare": 1}) == {"rare": [rule]}
    assert list(rule_index([parse_pattern("ad*")], {})) == [""]
