import random
import re

from lodestone.llm.url_filter import declared_links, filter_urls, resolved, with_address

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def node(url):
    host, path = parts(url)
    asked = re.match(r"[^?#]*\?([^#]*)", url.split("://", 1)[1]) if host else None
    kept = sorted(p for p in (asked[1] if asked else "").split("&") if p and not re.match(r"(utm_[^=&]*|gclid|fbclid|msclkid|mc_eid|ref)(=|$)", p))
    return (re.sub(":(80|443)?$", "", host) + re.sub("/$", "", path) + ("?" + "&".join(kept) if kept else "")) if host else None


def brute(urls, links, rules):
    def rule(url):
        host, path = parts(url)
        fits = [(-len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return min(fits)[1:] if fits else (None, None)

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if node(a) and node(b):
            root[find(node(a))] = find(node(b))
    said = {}
    for u in [*urls, *(x for pair in links for x in pair)]:
        if node(u) and rule(u)[0]:
            said.setdefault(find(node(u)), set()).add(rule(u)[0])
    out = []
    for i, u in enumerate(urls):
        verdict, name = rule(u)
        shut = node(u) is not None and said.get(find(node(u))) == {"block"}
        out.append((i, *parts(u), name, verdict or ("block" if shut else "allow"), "rule" if verdict else "alias" if shut else "default"))
    return sorted(out, key=str)


def rules_of(spark, rules=RULES):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(3)
    hosts = ["a.example.org", "example.org", "x.com", "COM", "example.net", "b.net:80", "notcom", "net.", "org", *(f"h{i}.net" for i in range(40))]
    paths = ["/es/", "/en/1", "/en/12", "/fr/2", "/de/", "/de", "", "/", "/q?b=2&a=1", "/q?a=1&b=2&utm_x=3", "/q/#top", "?ref=x", "#a"]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(150)] + [None, "", "no scheme", "://", "http://", "http://org"] + ["http://example.net/de/"] * 40
    links = [(r.choice(urls[:150]), r.choice([*urls[:150], "http://out.side/x", "http://m.com/de/9"])) for _ in range(50)] + [("http://h1.net/only", "http://m.com/de/9"), ("http://h1.net/only?ref=z", "http://h2.net/last")]
    urls += ["http://h1.net/only", "https://h2.net/last/#x"]
    html = {}
    for a, b in links[:25]:
        html.setdefault(a, "")
        html[a] += r.choice(['<link rel="canonical" href="{}">', "<LINK href='{}' rel='nofollow CANONICAL' />", '<meta http-equiv="refresh" content="0; url={}">', "<meta property=og:url content={}>"]).format(b.replace("&", "&amp;"))
    pages = spark.createDataFrame([(i, u, html.get(u), "x") for i, u in enumerate(urls)], "page_id long, url string, html string, node string").repartition(4)
    redirects = spark.createDataFrame([*links[25:], (None, "http://x.com/"), ("http://x.com/de/3", None)], "src string, dst string")
    seen = [(a, b.split("#")[0] if x < 25 and not b.startswith("http") else b) for x, (a, b) in enumerate(links)]
    df = filter_urls(pages, rules_of(spark), redirects)
    got = result(df)
    assert got == brute(urls, seen, RULES)
    assert {x[-1] for x in got} == {"rule", "alias", "default"}
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_allow_precedes_block_and_chains_are_followed(spark):
    net = [f"http://n{i}.net/" for i in range(12)]
    chain = list(zip(net[:-1], net[1:])) + [(net[-1], "https://x.com/de/1")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*net, "http://x.com/de/1", "http://y.com/de/2", "http://z.net/"])], "page_id long, url string")
    got = {x.page_id: (x.verdict, x.by) for x in filter_urls(pages, rules_of(spark), spark.createDataFrame([*chain, ("http://z.net/", "http://y.com/de/2"), ("http://y.com/de/2", "http://w.com/fr/1")], "src string, dst string"), html=None).collect()}
    assert all(got[i] == ("block", "alias") for i in range(12)) and got[12] == ("block", "rule")
    assert got[13] == ("block", "rule") and got[14] == ("allow", "default")  # its component holds an allow


def test_links_in_pages(spark):
    page = "http://h.net/a/b/c?x=1"
    rows = [
        ('<!-- <link rel=canonical href="/no"> --><link rel=canonical href="/yes">', ["http://h.net/yes"]),
        ('<script>"<link rel=canonical href=/no>"</script><link rel="canonical" href="d?y=2#f">', ["http://h.net/a/b/d?y=2"]),
        ("<link rel=canonical href='../e'><link rel=stylesheet href=/canonical.css>", ["http://h.net/a/e"]),
        ('<meta http-equiv="Refresh" content="5;URL=\'//o.net/z\'">', ["http://o.net/z"]),
        ('<meta http-equiv=refresh content=30>', []),
        ('<meta property="og:url" content="https://h.net/q?a=1&amp;b=2">', ["https://h.net/q?a=1&b=2"]),
        ('<link rel=canonical href="mailto:a@b.c"><link data-rel=canonical href=/no>', []),
        ('<link rel=canonical href="./"><!-- open <link rel=canonical href="/no">', ["http://h.net/a/b/"]),
        ("canonical" + "<!--" * 200_000, []),
        ("refresh" + "<meta " * 200_000, []),
    ]
    pages = spark.createDataFrame([(page + str(i), h) for i, (h, _) in enumerate(rows)], "url string, html string")
    got = {}
    for x in declared_links(pages).collect():
        got.setdefault(int(x.src[len(page) :]), []).append(x.dst)
    assert [sorted(got.get(i, [])) for i in range(len(rows))] == [w for _, w in rows]


def test_ties_empty_tables_and_longest_rule(spark):
    rules = [("b.net", "/x", "block"), ("a.b.net", "/", "allow"), ("b.net", "/xyz", "allow"), ("b.net", "/xyz", "block"), ("", "/", "block"), (None, "/", "block")]
    pages = spark.createDataFrame([(1, "http://a.b.net/xyz"), (1, "http://a.b.net/xyz"), (None, "http://B.net/x?q"), (2, None)], "page_id long, url string")
    got = result(filter_urls(pages, rules_of(spark, rules), html=None))
    assert got == sorted([(1, "a.b.net", "/xyz", "b.net/xyz", "allow", "rule")] * 2 + [(None, "b.net", "/x", "b.net/x", "block", "rule"), (2, "", "", None, "allow", "default")], key=str)
    assert filter_urls(pages.limit(0), rules_of(spark), html=None).count() == 0
    assert {x.verdict for x in filter_urls(pages, rules_of(spark).limit(0), html=None).collect()} == {"allow"}


def test_parts_and_normal_form(spark):
    urls = ["HTTP://User@Ex.ORG:443/A/?b=1&a=2&utm_q=1#f", "http://x/y#a?b", "http://x?a#b/c", "a://b://c", "http://ÄB.de/É"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = with_address(df, "url", node="node").collect()
    assert [tuple(x)[1:] for x in got] == [(*parts(u), node(u)) for u in urls]
    assert resolved(spark.createDataFrame([("http://h.net", "x")], "src string, link string")).first()[-1] == "http://h.net/x"
