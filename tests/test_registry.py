"""Every query answers as its SQL does; a sample of them here, all of them in the driver's gate."""

import duckdb
import pytest

import __spark_entry__
from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "clean_mask rank_clean region_map name_mapping fuzzy_lev ranked_pages pane_pages csv_round_trip tokens token_modes window_filter df_filter df_elbow "
    "topk_terms sim_stats matched_sim matched_jaccard silhouette crosstab radar timeline_10k term_groups cluster_profile kwic_prev split_words entropy"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(names) == cols and got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["a", "b", "weight"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
