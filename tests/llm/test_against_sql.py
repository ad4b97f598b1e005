"""Queries that SQL can express, over whole tables."""

import duckdb
import pytest

from tallyhouse.llm.queries import QUERIES
from tallyhouse.llm.statements import STATEMENTS
from tests.comparing import differences
from tests.conftest import SMALL


def duck(folder):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(STATEMENTS))
def test_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), duck(SMALL).sql(STATEMENTS[name])) == []


def test_links_match_sql(spark, tmp_path):
    """The given pages have no links between hosts; these have."""
    hosts = [f"h{i}.example.org" for i in range(12)] + [f"b{i}.net" for i in range(5)] + [f"c{i}.test" for i in range(16)]
    pages = []
    for i in range(300):
        links = "".join(f'<a href="https://{hosts[(i * 7 + k * k * 5) % 33].upper()}/x">' for k in range(i % 4))
        pages.append((i, f"{['http', 'x'][i % 2]}://{hosts[i % 33].title()}{['/en/1', '/fr/', '', '/'][i % 4]}{['', '?q=/a', '#t'][i % 3]}", links))
    pages += [(300, None, None), (301, "no scheme", ""), (302, "http://", "x"), (302, "http://", "x")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/p")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    spark.read.parquet(f"{tmp_path}/p").write.parquet(f"{tmp_path}/pages.parquet")
    ours = QUERIES["op6_url_filters"](spark, str(tmp_path))
    assert differences(ours, con.sql(STATEMENTS["op6_url_filters"])) == []
    assert {r.verdict for r in ours.filter("rule IS NULL").collect()} == {"allow", "block"}
