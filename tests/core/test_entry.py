import duckdb
import pytest

import __spark_entry__ as entry
from tracklens.plans import registry

VIEWS = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_reference_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["subsample_frames", "sample_rest_frames", "mask_iou", "tracking_metrics", "classification_report"])
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM '{sf_dir}/{v}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = con.execute(f"SELECT {quoted} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    want = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in want), key=repr)
    assert got == want
