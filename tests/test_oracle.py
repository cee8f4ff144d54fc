"""Every query that has SQL gives the rows of that SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from loomwork.plans.registry import collect

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
R = collect()
#: Two of each family here; the driver compares all of them.
SOME = [
    "pricing_summary", "cast__integer_half_even", "fill_null__forward", "text__title", "join__full", "pivot", "pareto", "window__rolling_mean", "compare_rows", "date_business_days",
    "profile__numeric", "rule_suite", "rec_cells", "rec_rows", "mig_reject", "sem_offset_scalar", "sem_offset_grouped", "drift", "spearman", "ols", "ml_pareto", "ml_knn", "ml_resample",
    "el_pair", "el_parse", "pm_dfg", "pm_waiting", "pm_overlap", "pm_conform_steps", "txt_bm25", "page_change", "vec_topk", "src_folder", "src_records", "snk_version", "ss_rollup",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 4) + 0.0
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "year"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    return float(v) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)


def rows(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    return sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    got, want = R.queries[name](spark, SF).toPandas(), duck.sql(R.oracle[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_sql_belongs_to_queries():
    assert set(R.oracle) <= set(R.queries) and len(R.queries) > 200
