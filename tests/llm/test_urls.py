from seriesloom.llm import urls


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = rest[:end], rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] + [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:stop]


def fitting(host, path):
    fits = [r for r, _ in urls.RULES if (host == r[:r.index("/")] or host.endswith("." + r[:r.index("/")])) and path.startswith(r[r.index("/"):])]
    return max(fits, key=len) if fits else None


ODD = [None, "", "no scheme", "http://", "://x.com/a", "HTTP://WWW.Example.COM/en/1?x=1#y", "https://example.com/en/", "https://example.com/EN/",
       "http://badexample.com/en/x", "http://com/", "http://com", "http://a.net/es/1", "http://a.net?/es/", "http://a.net#/fr/", "http://É.net/fr/2",
       "http://x.org/a/b/c/d/e.html?p=1&&q=2", "a://b://c.com/", "http://example.com/en/1\nnew", "http://exa mple.net/fr/", "http://x.com//"]


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)] * 2 + [(None, "http://x.com/")], "page_id long, url string")
    got = urls.judged_urls(pages).collect()
    assert len(got) == 2 * len(ODD) + 1
    for r in got:
        if r["page_id"] is not None:
            host, path = plain(ODD[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, fitting(host, path)), ODD[r["page_id"]]
        assert r["verdict"] == dict(urls.RULES).get(r["rule"], r["verdict"]) and r["verdict"] in ("allow", "block")
    assert urls.judged_urls(pages.limit(0)).count() == 0


def test_mined_rules_are_supported_confident_and_matched(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    known = urls.parsed(pages).cache()
    labelled = [(frozenset(r["tokens"]), r["given"]) for r in known.where("given is not null").collect()]
    mined = urls.mine(known.where("given is not null"))
    assert mined
    for m in mined:
        fits = [v for t, v in labelled if m.tokens <= t]
        assert abs(m.confidence - fits.count(m.verdict) / len(fits)) < 1e-9 and m.confidence >= urls.CONFIDENCE
        assert abs(m.support - fits.count(m.verdict) / len(labelled)) < 1e-9 and m.support >= urls.SUPPORT - 1e-9
        assert len(m.tokens) <= urls.TOKENS
    for r in urls.matched(known, mined).collect():
        first = next((m.verdict for m in mined if m.tokens <= set(r["tokens"])), urls.DEFAULT)
        assert r["verdict"] == (r["given"] or first)


def test_rules_use_the_whole_url(spark):
    deep = "http://s.t.u.v.w.org/es/b/c/d/deep?a=1&b=2&c=3&d=4&e=5"
    rows = [f"http://a{i}.net/es/b/c/d/deep" for i in range(20)] + [f"http://a{i}.com/es/b/c/d/other" for i in range(20)] + [deep]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    tokens = urls.parsed(pages).where("page_id = 40").first()["tokens"]
    assert {"path4=deep", "query=e", "host=t.u.v.w.org", "host=s.t.u.v.w.org"} <= set(tokens)
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judged_urls(pages).collect()}
    assert verdicts[40] == "block"
