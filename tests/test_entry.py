import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings track_nodes track_edges link_scores ultrack_windows splits route eval_items".split()


def test_flagship_has_rows(spark):
    assert __spark_entry__.entry(spark).take(1)


def test_sql_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["p2_found", "p4_found", "sj_candidates", "wn_rank_src", "gr_segments", "sink_add_id", "gr_alt_rescue"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    said = con.execute(__spark_entry__.oracle_sql()[name])
    at = [[c[0] for c in said.description].index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in said.fetchall())
