import os

import duckdb
import pytest

from millrace.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels embeddings".split()


def cells(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda x: "null" if x is None or str(x) in ("NaT", "<NA>", "nan") else f"{x:.9g}" if isinstance(x, float) else str(x).removesuffix(" 00:00:00")
    number = lambda x: text(float(x)) if isinstance(x, int) and not isinstance(x, bool) else text(x)
    return list(frame.columns), sorted(tuple(number(x) for x in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the standard tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert cells(catalog.queries()[name](spark, SF).toPandas()) == cells(db.sql(catalog.oracle_sql()[name]).df())
