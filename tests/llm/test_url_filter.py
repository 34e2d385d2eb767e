"""URL filters: parsing and rules against plain code, the model on urls it has not seen."""

from pyspark.sql import functions as F

from plumbline.llm import url_filter as uf
from plumbline.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM", "https://x.example.com/en/1?q=/fr/#z", "http://www.example.com/en/",
    "http://example.com/en", "ftp://a.net/es/1", "http://net/fr/", "http://anet/fr/", "http://h?x://y/", "http://h#a/b", "x://a://b/en/",
    "http://é.com/ü", "http://a.com/" + "x" * 20000, "http://user@b.NET:80/fr/1", "http://sub.www.example.com/en/x", "://a.com/",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fit = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else (None, None)


def test_rules_match_plain_code(spark):
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, rule string")
    got = uf.judge(df, URL_RULES, uf.labelled_urls(spark).limit(0)).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, (rule, action) = plain(URLS[r.row.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (action or "allow")


def test_model_on_unseen_urls(spark):
    bad = ["https://mega-casino.example.com/en/7", "http://m.pills-cheap.example.org/de/1", "http://online-poker.example.net/en/2", "http://free-xxx.example.org/en/3"]
    good = ["https://localnews.example.com/en/7", "http://m.enterand.example.org/de/1", "http://school-books.example.net/en/2", "http://hendon.example.org/x"]
    df = spark.createDataFrame([(u,) for u in bad + good], "url string")
    got = {r.row.url: r.verdict for r in uf.judge(df, [], uf.labelled_urls(spark)).collect()}
    assert all(got[u] == "block" for u in bad) and all(got[u] == "allow" for u in good)
    assert uf.judge(df.where(F.lit(False)), [], uf.labelled_urls(spark)).count() == 0
