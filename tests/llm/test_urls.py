"""The automaton against regular expressions, and URL rules."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm.queries import URL_GLOBS, URL_RULES
from folioflow.llm.url_filter import GlobAutomaton, judge_urls


def regex(glob):
    return re.compile("".join({"**": "(?s:.*)", "*": "[^/]*"}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*)", glob)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab/*é", max_size=9), min_size=1, max_size=30), st.lists(st.text("ab/é", max_size=12), min_size=1, max_size=8))
def test_automaton(globs, texts):
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    encoded = [t.encode() for t in texts]
    got = GlobAutomaton(globs).match(np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)]))
    assert got.tolist() == [[bool(regex(g).fullmatch(t)) for g in globs] for t in texts]


def test_rules(spark):
    urls = {
        "https://WWW.Example.com/en/1?x=/fr/": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
        "http://xexample.com/en/": ("xexample.com", "/en/", "com/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://example.com?q=/": ("example.com", "", None, "allow"),
        "http://b.net/es/x#y": ("b.net", "/es/x", "net/es/", "block"),
        "http://b.net/x.com/": ("b.net", "/x.com/", None, "allow"),
        "http://m.b.org/": ("m.b.org", "/", None, "block"),
        "http://b.org/print/1": ("b.org", "/print/1", None, "block"),
        "nothing": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://" + "a" * 50_000 + "/\n": ("a" * 50_000, "/\n", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string").repartition(2)
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(df, URL_RULES, URL_GLOBS).collect()}
    assert got == dict(enumerate(urls.values()))
    assert judge_urls(df.where("false"), URL_RULES).count() == 0
