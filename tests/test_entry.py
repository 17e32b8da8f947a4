from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def test_names():
    assert not set(entry.oracle_sql()) - set(entry.queries())


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() == 50


@needs_data
@pytest.mark.parametrize("name", ["url_parts", "page_links", "html_to_markdown", "page_measures", "chunk_whole", "data_card", "job_outcomes", "policy_strict", "crawl_limited"])
def test_oracle(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("pages", "documents", "conversations", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(map(str, r)) for r in cursor.fetchall())
    got = sorted(tuple(map(str, r)) for r in entry.queries()[name](spark, str(DATA)).select(*(f"`{n}`" for n in names)).collect())
    low = lambda rows: [tuple(x.lower() if x in ("True", "False") else x for x in r) for r in rows]
    assert low(got) == low(want)


def test_crawl_grows_with_its_table(spark, tmp_path):
    import duckdb

    deepest = []
    for n in (40, 700):
        folder = tmp_path / str(n)
        spark.range(n).selectExpr("id AS page_id", "'u' AS url", "'' AS html").coalesce(1).write.parquet(f"{folder}/pages.parquet")
        want, level, depth = {}, [0], 0
        while level:
            want |= {f"p{i}": (depth, i < n and i % 9 != 8) for i in level}
            level, depth = [j for i in level if want[f"p{i}"][1] for j in (2 * i + 1, 2 * i + 2)], depth + 1
        db = duckdb.connect()
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
        rows = entry.queries()["crawl_whole"](spark, str(folder)).collect()
        assert len(rows) == len(want) and {r.url: (r.depth, r.ok) for r in rows} == want
        assert sorted(db.execute(entry.oracle_sql()["crawl_whole"]).fetchall()) == sorted(map(tuple, rows))
        deepest.append(max(r.depth for r in rows))
    assert 4 < deepest[0] < deepest[1]


@needs_data
def test_links_convert_a_page_once(spark):
    plan = entry.queries()["page_links"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
