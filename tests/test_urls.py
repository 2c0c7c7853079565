from urllib.parse import urlparse

from broadsheet.functions.urls import (
    domain_variants, source_url_norm, url_domain, url_host, url_netloc, url_netloc_nowww,
)

URLS = [
    "https://User:pw@WWW.Ex.com:80/a?b#c", "ex.com/a", "//cdn.ex.com?x=1/2", "http://ex.com#top/x",
    "www.ex.com", "", "mailto:a@b.c", "HTTP://EX.com", "1http://no.com/x", "ex.com:80/a",
]


def test_netloc_equals_python(apply):
    assert apply(url_netloc, URLS) == [urlparse(u).netloc or u for u in URLS]


def test_domain(apply):
    urls = ["HTTPS://WWW.Ex.com:80/a/b", "www.ex.com?x", "http://news.ex.com", None, "ex.com"]
    assert apply(url_domain, urls) == ["ex.com:80", "ex.com?x", "news.ex.com", None, "ex.com"]


def test_netloc_without_www(apply):
    urls = [" HTTPS://WWW.Ex.com/a ", "ex.com/a", None, "http://[ex.com/x", "http://www.www.ex.com"]
    assert apply(url_netloc_nowww, urls) == ["ex.com", "", "", None, "www.ex.com"]


def test_source_norm_cuts_nothing(apply):
    assert apply(source_url_norm, [" HTTPS://Ex.com/ ", None]) == ["https://ex.com/", None]


def test_host(apply):
    assert apply(url_host, ["https://u:p@WWW.Ex.com:8080/a", "ex.com/a"]) == ["www.ex.com", ""]


def test_variants_in_order(apply):
    got = apply(domain_variants, [" Ex.com", "www.ex.com"])
    assert got[0] == [
        "ex.com", "www.ex.com", "news.ex.com", "blog.ex.com", "m.ex.com", "mobile.ex.com",
        "editorial.ex.com",
    ]
    assert got[1][:2] == ["www.ex.com", "news.www.ex.com"] and len(got[1]) == 6
