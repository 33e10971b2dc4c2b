"""Every query with an oracle gives what DuckDB gives on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidewater.plans.catalogue import CATALOGUE
from tidewater.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def shown(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return None
        if isinstance(v, bool) or "bool" in str(type(v)):
            return bool(v)
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    cols = sorted(frame.columns)
    return sorted((tuple(shown(v) for v in r) for r in frame[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    ours, theirs = CATALOGUE[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_but_the_models_has_an_oracle():
    assert set(CATALOGUE) - set(ORACLE) == {"capture_model_gbt", "capture_model_logreg", "feature_importance", "text_sector_model", "confusion_pairs"}
