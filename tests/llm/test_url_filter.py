import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartstone.llm.url_filter import GlobAutomaton, UrlJudge, filter_urls, glob_to_regex

GLOBS = st.lists(st.text("ab/*?.", max_size=7), min_size=1, max_size=12)


@settings(max_examples=150, deadline=None)
@given(GLOBS, st.lists(st.text("ab/.", max_size=10), max_size=8))
def test_automaton_equals_regular_expressions(globs, urls):
    hit = GlobAutomaton(globs).match([u.encode() for u in urls])
    want = [[re.match(glob_to_regex(g), u) is not None for g in globs] for u in urls]
    assert hit.tolist() == want


def test_many_patterns_span_words():
    globs = [f"*host{i}.example/**" for i in range(40)]
    hit = GlobAutomaton(globs).match([f"www.host{i}.example/x/y".encode() for i in range(40)])
    assert hit.nonzero()[0].tolist() == hit.nonzero()[1].tolist() == list(range(40))


@pytest.mark.parametrize(
    "host,path,rule,verdict",
    [
        ("a.com", "/x", "com/", "allow"),
        ("example.com", "/en/1", "example.com/en/", "block"),
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("badexample.com", "/en/1", "com/", "allow"),
        ("x.net", "/es/", "net/es/", "block"),
        ("x.net", "/esx", None, "allow"),
        ("a.com", "", None, "allow"),
        ("a.org", "/x.com/en/", None, "allow"),
        ("a.org", "/login", None, "block"),
        ("a.com", "/login", "com/", "allow"),
    ],
)
def test_rules(host, path, rule, verdict):
    r, v, _ = UrlJudge().judge([host], [path])
    assert (r[0], v[0]) == (rule, verdict)


def test_edges(spark):
    urls = [None, "", "no scheme", "HTTP://A.COM?x", "x://HÖST.net/es/é#f", "a://b://c/d", "http://" + "a" * 5000 + ".net/fr/" + "b" * 5000]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, None, "x")], "page_id long, url string, host string")
    got = {(r.page_id, r.host[:10], r.path[:10], r.rule, r.verdict) for r in filter_urls(df, "page_id", "url").collect()}
    assert got == {
        (0, "", "", None, "allow"),
        (1, "", "", None, "allow"),
        (2, "", "", None, "allow"),
        (3, "a.com", "", None, "allow"),
        (4, "hÖst.net", "/es/é", "net/es/", "block"),
        (5, "b:", "//c/d", None, "allow"),
        (6, "a" * 10, "/fr/bbbbbb", "net/fr/", "block"),
    }
    assert filter_urls(df.limit(0), "page_id", "url").count() == 0
