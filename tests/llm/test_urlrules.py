import re

from roadglass.llm import queries, urlrules


def judge(spark, rows, rules=urlrules.RULES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as rule", "'z' as address", "3 as id")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(df, rules).collect()}


def test_hosts_paths_and_rules(spark):
    got = judge(
        spark,
        [
            (1, "http://A.Example.COM/en/x?q#f", ""),
            (2, "http://www.example.com/en/x", ""),
            (3, "http://example.net/fr/a", ""),
            (4, "http://example.org/en/", ""),
            (5, None, ""),
            (6, "no scheme", ""),
            (7, "http://example.com", None),
            (8, "http://notexample.com/en/", ""),
            (9, "x://h?a=://b/c", ""),
            (10, "http://sub.www.example.com/en/y#z?w", ""),
        ],
    )
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3][2:] == ("net/fr/", "block")
    assert got[4][2:] == (None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("example.com", "", None, "allow")
    assert got[8][2:] == ("com/", "allow")
    assert got[9] == ("h", "", None, "allow")
    assert got[10] == ("sub.www.example.com", "/en/y", "www.example.com/en/", "allow")


def brute(rows):
    """Components by union-find over addresses; the block of an alias holds unless one is allowed."""
    host = lambda u: re.match(r"(?s)^.*?://([^/?#]*)", u)[1].lower()
    path = lambda u: re.match(r"(?s)^.*?://[^/?#]*([^?#]*)", u)[1]

    def rule(u):
        fits = [(len(h + p), v, h + p) for v, h, p in urlrules.RULES if (host(u) == h or host(u).endswith("." + h)) and path(u).startswith(p)]
        return max(fits)[1:] if fits else None

    address = lambda u: host(u) + re.sub(r"(/index\.html?|/)$", "", path(u))
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    seen = []
    for _, u, target in rows:
        seen.append(u)
        if target:
            seen.append(target)
            root[find(address(u))] = find(address(target))
    verdicts = {}
    for u in seen:
        if r := rule(u):
            verdicts.setdefault(find(address(u)), set()).add(r[0])
    out = {}
    for i, u, _ in rows:
        r = rule(u)
        out[i] = r[0] if r else "block" if verdicts.get(find(address(u))) == {"block"} else "allow"
    return out


def test_aliases_share_blocks(spark):
    """Chains, a hub that a third of all pages point to, and an alias that a rule allows."""
    rows = [(i, f"https://p{i}.org/x", f"https://p{i + 1}.org/x") for i in range(40)]
    rows += [(100, "https://p40.org/x", "https://bad.example.net/es/y")]
    rows += [(200 + i, f"http://q{i}.org/a/", "https://hub.org/") for i in range(60)] + [(300, "https://hub.org/index.html", "http://x.net/fr/")]
    rows += [(400, "https://r.org/", "http://x.net/fr/z"), (401, "https://r.org", "https://www.example.com/en/ok"), (402, "https://lone.org/", None)]
    tags = ('<link rel="canonical" href="{}">', "<LINK href='{}' REL=canonical>", '<meta http-equiv="refresh" content="0; url={}">')
    pages = [(i, u, f"<html>{tags[k % 3].format(t) if t else ''}</html>") for k, (i, u, t) in enumerate(rows)]
    got = judge(spark, pages)
    assert {i: v[3] for i, v in got.items()} == brute(rows)
    assert got[0][3] == got[205][3] == "block" and got[401][3] == "allow"


def test_relative_links(spark):
    got = judge(spark, [(1, "https://a.net/fr/x", ""), (2, "https://a.net/de/y", '<link rel="canonical" href="/fr/x">'), (3, "https://a.net/de/z", '<link rel="canonical" href="//b.net/es/q">'), (4, "https://a.net/de/", '<link rel="canonical" href="y">')])
    assert [got[i][3] for i in (1, 2, 3, 4)] == ["block"] * 4


def test_empty_and_native(spark):
    assert judge(spark, []) == {}
    q = queries.QUERIES["op7_url_filter"](spark, "/root/testdata/sf0.001")
    assert "Python" not in q._jdf.queryExecution().toString()


def test_entities_in_links(spark):
    """A link's target is read with its entities decoded."""
    page = '<link rel="canonical" href="http://x.org/a?b=1&amp;c=2">'
    got = judge(spark, [(1, "http://x.org/a?b=1&c=2", ""), (2, "http://y.org/copy", page), (3, "http://example.net/fr/z", page.replace("amp;", "#38;")), (4, "http://x.org/a?b=1", "")])
    assert [got[i][3] for i in (1, 2, 3, 4)] == ["block", "block", "block", "allow"]
