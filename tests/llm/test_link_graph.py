import pytest

from tallyhouse.llm import link_graph as lg

SCHEMA = "page_id bigint, url string, html string, src string, n int"


def judged(spark, folder, pages, **how):
    docs = spark.createDataFrame([(*p, "x", 1) for p in pages], SCHEMA)
    return {r.page_id: r for r in lg.judge(docs, folder, **how).collect()}


@pytest.mark.parametrize("url, host, path, rule", [
    (None, "", "", None), ("", "", "", None), ("a.net/x", "", "", None), ("http://", "", "", None), ("http://a.net", "a.net", "", None),
    ("http://A.NET/", "a.net", "/", "net/"), ("x://net/a?b#c", "net", "/a", "net/"), ("http://www.example.net/en/a", "www.example.net", "/en/a", "example.net/en/"),
    ("http://myexample.net/en/a", "myexample.net", "/en/a", "net/"), ("http://example.com/de/", "example.com", "/de/", "example.com/de/"),
    ("http://example.com/de", "example.com", "/de", None), ("http://a.org/fr/x?y", "a.org", "/fr/x", "org/fr/"), ("http://a.org?x=/fr/", "a.org", "", None),
    ("http://a.org#/fr/", "a.org", "", None), ("http://É.Org/fr/", "É.org", "/fr/", "org/fr/"), ("u://a://b/c", "a:", "//b/c", None),
    ("http://a\n.net/x", "a\n.net", "/x", "net/"),
])
def test_rules(spark, folder, url, host, path, rule):
    row = judged(spark, folder, [(1, url, None)])[1]
    verdict = {None: "allow", "net/": "block", "example.com/de/": "block"}.get(rule, "allow")
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_distrust_flows_against_links_and_trust_along(spark, folder):
    link = lambda *hosts: "".join(f"<a href='//{h}/'>" for h in hosts)
    rows = judged(spark, folder, [
        (1, "http://bad.net/", ""), (2, "http://farm.test/", link("bad.net")), (3, "http://good.org/fr/", link("Friend.test")),
        (4, "http://friend.test/", link("bad2.net")), (5, "http://bad2.net/", ""), (6, "http://bad2.net", ""), (7, "http://alone.test/", link("alone.test")),
    ])
    assert [rows[i].verdict for i in range(1, 8)] == ["block", "block", "allow", "allow", "block", "block" if rows[6].distrust > 0.5 else "allow", "allow"]
    assert rows[2].distrust == pytest.approx(0.85)
    assert rows[4].trust == pytest.approx(0.85)


def test_scores_solve_their_equations(spark, folder):
    """Against the linear systems, solved: trust = seed + 0.85 S' trust, distrust = seed + (1 - seed) 0.85 S distrust."""
    import numpy as np

    hosts = [f"h{i}.test" for i in range(9)] + ["a.net", "b.org"]
    links = {(i, j) for i in range(11) for j in range(11) if i != j and (i * 3 + j * 7) % 4 == 0}
    path = lambda i: "fr/" if i == 10 else ""
    pages = [(i, f"http://{hosts[i]}/{path(i)}", "".join(f'<a href="http://{hosts[j]}/">' for k, j in sorted(links) if k == i)) for i in range(11)]
    pages.append((11, "http://h3.test/x", ""))
    rows = judged(spark, folder, pages, still=1e-12)
    share = np.zeros((11, 11))
    for i, j in links:
        share[i, j] = 1 / sum(k == i for k, _ in links)
    bad, good = np.eye(11)[9], np.eye(11)[10]
    trust = np.linalg.solve(np.eye(11) - 0.85 * share.T, good)
    distrust = np.linalg.solve(np.eye(11) - 0.85 * (1 - bad)[:, None] * share, bad)
    assert [rows[i].trust for i in range(11)] == pytest.approx(trust.tolist())
    assert [rows[i].distrust for i in range(11)] == pytest.approx(distrust.tolist())
    assert 0 <= distrust.min() and distrust.max() <= 1


@pytest.mark.parametrize("size", [1, 2, 10, 100])
def test_farms_of_any_size_are_blocked(spark, folder, size):
    """Hosts that link only to one blocked host; their neighbours, that also link elsewhere, are left alone."""
    link = lambda *hosts: "".join(f"<a href='//{h}/'>" for h in hosts)
    pages = [(0, "http://bad.net/", "")]
    pages += [(i, f"http://farm{i}.test/", link("bad.net")) for i in range(1, size + 1)]
    pages += [(200 + i, f"http://next{i}.test/", link("bad.net", "a.test", "b.test")) for i in range(3)]
    pages += [(300, "http://chain.test/", link("farm1.test")), (301, "http://read.test/", ""), (302, "http://far.test/", link("next0.test"))]
    rows = judged(spark, folder, pages)
    assert {i for i, r in rows.items() if r.verdict == "block"} == {0, *range(1, size + 1), 300}


def test_repeated_rows_and_an_empty_table(spark, folder):
    docs = spark.createDataFrame([(1, "http://a.net/", "<a href=http://b.test>", "x", 1)] * 3, SCHEMA)
    assert [r.verdict for r in lg.judge(docs, folder).collect()] == ["block"] * 3
    assert lg.judge(docs.limit(0), folder).collect() == []
