from pyspark.sql import functions as F

from rankloom.llm import links


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")


def test_rules_and_odd_urls(spark):
    urls = [None, "", "no scheme", "https://A.Example.ORG/en/1x?y#z", "http://example.org/es/", "http://x.example.org",
            "http://shop.com/de/1", "http://shop.com/de", "ftp://com/fr/?://org/", "http://notorg/", "http://org#/", "http://org/\n/x"]
    df = pages(spark, [(k, u, None, "x", "y") for k, u in enumerate(urls)] + [(3, urls[3], None, None, None)])
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in links.filter_urls(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/en/1x", "example.org/en/1", "block")
    assert got[4] == ("example.org", "/es/", "example.org/es/", "block")
    assert got[5][1:3] == ("", None) and got[6][2:] == ("com/de/", "block") and got[7][2] is None
    assert got[8] == ("com", "/fr/", "com/fr/", "allow") and got[9][2] is None and got[10][1:3] == ("", None)
    assert got[11] == ("org", "/\n/x", "org/", "allow")
    assert links.filter_urls(df).count() == 13 and links.filter_urls(df.limit(0)).count() == 0


def test_propagation_follows_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    df = pages(spark, [(1, "http://good.org/a", link("friend.net"), None, None), (2, "http://friend.net/q", None, None, None),
                       (3, "http://bad.com/de/1", None, None, None), (4, "http://feeder.net/1", link("bad.com", "BAD.com"), None, None),
                       (5, "http://far.net/1", None, None, None)])
    got = {r.page_id: r for r in links.filter_urls(df).collect()}
    assert got[2].verdict == "allow" and got[2].trust > 0
    assert got[4].verdict == "block" and got[4].distrust > 0
    assert got[5].verdict == "allow" and got[5].trust == 0
    edges = links.host_edges(df.withColumn("host", links.host_and_path(F.col("url"))[0]))
    assert ("feeder.net", "bad.com") in {tuple(r) for r in edges.collect()}


def test_blocked_pages_elsewhere_do_not_change_a_host(spark):
    near = [(1, "http://site.com/fr/1", None, None, None), (2, "http://site.com/fr/2", None, None, None),
            (3, "http://site.com/de/1", None, None, None), (4, "http://site.com/x", None, None, None),
            (5, "http://other.com/de/1", None, None, None), (6, "http://other.com/x", None, None, None)]
    far = [(100 + k, f"http://h{k}.net.com/{'de' if k % 9 else 'fr'}/1", None, None, None) for k in range(60)]
    for more in ([], far, [(r[0], r[1].replace("/de/", "/fr/"), *r[2:]) for r in far]):
        got = {r.page_id: r.verdict for r in links.filter_urls(pages(spark, near + more)).collect()}
        assert (got[4], got[6]) == ("allow", "block")


def test_ranks_as_in_plain_python(spark):
    arcs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "c")]
    seeds = {"a": (0.5, 0.0), "d": (0.5, 0.0), "c": (0.0, 1.0)}
    t, d = {h: x for h, (x, _) in seeds.items()}, {h: y for h, (_, y) in seeds.items()}
    for _ in range(links.STEPS):
        t2, d2 = ({h: 0.15 * seeds.get(h, (0, 0))[k] for h in "abcd"} for k in (0, 1))
        for x, y in arcs:
            t2[y] += 0.85 * t.get(x, 0) / sum(a == x for a, _ in arcs)
            d2[x] += 0.85 * d.get(y, 0) / sum(b == y for _, b in arcs)
        t, d = t2, d2
    got = links.propagate(spark.createDataFrame(arcs, "src string, dst string"),
                          spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, t double, d double"))
    for r in got.collect():
        assert abs(r.trust - t[r.host]) < 1e-9 and abs(r.distrust - d[r.host]) < 1e-9


def test_no_python_in_the_plan(spark, small_dir):
    from rankloom.llm.common import table
    text = links.filter_urls(table(spark, small_dir, "pages"))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def test_very_long_url_and_html(spark):
    """The last link behind a megabyte of text still carries distrust, and a long path is returned whole."""
    filler = "<p>words and words</p>" * 50_000
    tail = "/" + "p" * 100_000
    rows = [(1, "http://shop.com/de/1", None, None, None),
            (2, "http://far.net/a", filler + '<a href="http://shop.com/x">', None, None),
            (3, "http://other.net" + tail, filler, None, None)]
    got = {r.page_id: r for r in links.filter_urls(pages(spark, rows)).collect()}
    assert got[1].verdict == "block" and got[2].verdict == "block"
    assert got[3].path == tail and got[3].verdict == "allow"
