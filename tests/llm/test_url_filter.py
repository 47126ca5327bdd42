import re

from textloom.llm.entries import _glob_to_regex
from textloom.llm.url_filter import GLOBS, RULES, Automaton, filter_urls
from textloom.llm.scan import text_buffer

import numpy as np
import pyarrow as pa


def test_automaton_against_regex():
    globs = ["a*b", "**b", "*.net/**", "", "*", "x**", "*a*/**c*", *GLOBS, *["k" * 70 + "*z"]]
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("ab./cnetxkz"), r.integers(0, 14))) for _ in range(600)] + ["k" * 70 + "qz", "k" * 71, "", "a" * 3000 + "b", ".x.net/y"]
    got = Automaton(globs).run(*text_buffer(pa.array(texts)))
    for g, glob in enumerate(globs):
        rx = re.compile(_glob_to_regex(glob))
        assert [bool(rx.match(t)) for t in texts] == got[:, g].tolist(), glob


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, *max(fit, key=lambda x: len(x[0]))
    blocked = any(re.match(_glob_to_regex(g), f".{host}{path}") for g in GLOBS)
    return host, path, None, "block" if blocked else "allow"


def test_filter_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1?x#y", "https://example.net", "https://example.net?/en/", "http://net/", "http://x.net/fr", "http://a.org/fr/", "http://borg/fr/",
            "ftp://example.com/de/x#/fr", "https://m.ads.example.com/", "http://a.org/x.net/", "http://org//fr/", "x://ÄB.org/fr/ü", "http://e.com/a.zip", "http://e.com/a.zip?b", "a://b://c.net/", "http://x.com/" + "p" * 5000, "http://net/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert filter_urls(df.limit(0)).count() == 0
