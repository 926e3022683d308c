"""Every library query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from veilspark import queries as library

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in SF.iterdir():
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    got, want = library.QUERIES[name](spark, str(SF)).toPandas(), con.execute(library.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))
