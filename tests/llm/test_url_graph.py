from helpers import PAGES, rows_of

from kgspark.llm.url_graph import host_ranks, verdicts


def judged(spark, rows, **options):
    return {r["page_id"]: tuple(r)[1:5] for r in verdicts(spark.createDataFrame(rows, PAGES), **options).collect()}


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "https://Shop.Example.COM/En/a?x#y", None), (2, "http://example.com/en/x", ""), (3, "http://www.example.com/en/x", ""), (4, "http://www.example.com", ""),
        (5, "http://blog.site.net/es/1", ""), (6, "http://site.net/fr/", ""), (7, "http://site.net/de/#z", ""), (8, None, None), (9, "no scheme/x", ""), (10, "http://badcom/", ""),
        (11, "a://b://c/d", ""), (12, "http://", ""), (13, "http://h?q=/en/", ""),
    ]
    got = judged(spark, rows)
    assert got[1] == ("shop.example.com", "/En/a", "com/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("www.example.com/en/", "allow")
    assert got[4][1:] == ("", None, "allow")  # no path starts with "/"
    assert got[5] == ("blog.site.net", "/es/1", "net/es/", "block") and got[6][2:] == ("net/fr/", "block")
    assert got[7] == ("site.net", "/de/", None, "allow")  # half of the host's urls are blocked: not over the threshold
    assert got[8][:2] == ("", "") and got[9][:2] == ("", "") and got[12] == ("", "", None, "allow")
    assert got[10][2:] == (None, "allow") and got[11][:2] == ("b:", "//c/d") and got[13][:2] == ("h", "")


def reference(seeds, edges, damping, rounds):
    score = dict(seeds)
    for _ in range(rounds):
        new = dict(seeds)
        for (a, b), w in edges.items():
            new[b] = new.get(b, 0) + damping * w * score.get(a, 0)
        score = new
    return score


def test_ranks_equal_power_iteration(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">l</a>' for h in hosts)
    rows = [
        (1, "http://good.com/", link("mid.org", "mid.org", "far.org", "good.com")), (2, "http://mid.org/", link("far.org") + '<a href="/own">o</a>'),
        (3, "http://spam.org/", link("bad.net")), (4, "http://bad.net/es/", link("good.com")), (5, "http://far.org/", '<img src=//mid.org/i.png>'), (6, "http://lone.org/", None),
    ]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in host_ranks(spark.createDataFrame(rows, PAGES)).collect()}
    n = {("good.com", "mid.org"): 2, ("good.com", "far.org"): 1, ("mid.org", "far.org"): 1, ("spam.org", "bad.net"): 1, ("bad.net", "good.com"): 1, ("far.org", "mid.org"): 1}
    out, into = {}, {}
    for (a, b), k in n.items():
        out[a], into[b] = out.get(a, 0) + k, into.get(b, 0) + k
    trust = reference({"good.com": 1.0}, {e: k / out[e[0]] for e, k in n.items()}, 0.85, 12)
    distrust = reference({"bad.net": 1.0}, {(b, a): k / into[b] for (a, b), k in n.items()}, 0.85, 12)
    for host in {*trust, *distrust}:
        assert abs(got[host][0] - trust.get(host, 0)) < 1e-12 and abs(got[host][1] - distrust.get(host, 0)) < 1e-12
    found = judged(spark, rows)
    assert found[3][3] == "block" and found[2][3] == "allow" and found[6][3] == "allow"  # spam.org links to a blocked host


def test_repeats_clashes_and_empty(spark):
    rows = [(1, "http://a.org/x", "<a href='http://b.org'>"), (1, "http://a.org/x", "<a href='http://b.org'>"), (None, None, None)]
    df = spark.createDataFrame([(*r, "c", 1.0) for r in rows], PAGES + ", host string, trust double")
    assert rows_of(verdicts(df), "page_id", "host", "path", "rule", "verdict") == sorted([(1, "a.org", "/x", None, "allow")] * 2 + [(None, "", "", None, "allow")], key=repr)
    assert verdicts(spark.createDataFrame([], PAGES)).count() == 0
