"""The DuckDB SQL of the queries on awkward tables, against the same operators."""

import duckdb
import pytest

from capturelake.llm.oracle import ORACLE
from capturelake.llm.queries import queries

from .test_embedding import rows as vectors  # noqa: F401
from .test_licenses import TEXTS
from .test_urls import URLS


def threads():
    rows = [(7, 0, "user", "alpha one"), (7, 1, "user", "beta one"), (8, 0, "user", "First words here\nand more"), (8, 1, "b", "first WORDS, here!"), (8, 2, "a", " > First words here\nyes"), (8, 3, None, ">> and more\nno"), (8, 4, "a", "> yes\n> first words here"), (8, 5, "a", "> yes\nsecond branch"), (9, 3, "a", "> First words here\nno"), (9, 4, "a", None)]
    for k in range(1, 12):
        rows.append((7, 2 * k, "user", f"> alpha {'one' if k == 1 else f'n{k - 1}'}\nalpha n{k}"))
        rows.append((7, 2 * k + 1, "user", f"> beta {'one' if k == 1 else f'n{k - 1}'}\nbeta n{k}"))
    return rows


def plain(rows):
    return sorted(tuple("none" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, corpus, vectors, tmp_path, name):  # noqa: F811
    tables = {
        "op1": ("documents", "doc_id long, text string", corpus),
        "op3": ("pages", "page_id long, url string", list(enumerate([u for u in URLS if u is None or len(u) < 500] * 3))),
        "op4": ("documents", "doc_id long, text string", corpus),
        "op7": ("embeddings", "vec_id long, embedding array<float>", vectors),
        "op8": ("conversations", "conv_id long, turn long, role string, text string", threads()),
        "op9": ("documents", "doc_id long, text string", list(enumerate(TEXTS))),
    }
    table, schema, rows = tables[name.split("_")[0]]
    path = f"{tmp_path}/{table}.parquet"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    got = queries()[name](spark, str(tmp_path))
    cursor = db.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(cursor.fetchall())

