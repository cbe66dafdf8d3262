"""Every query of the subpackage on the smallest tables: fixed columns, and the rows of its SQL where it has one."""

import glob
import math
import os

import duckdb
import pytest

from mirthlake.llm import registry

COLUMNS = {"p1_found": "id_a id_b", "p2_found": "id_a id_b", "p3_found": "mark n_records n_uses term", "p4_found": "field_name id", "p5_found": "id_a id_b", "p8_found": "doc_id found_text kind"}
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_runs(spark, data, name):
    df = registry.queries()[name](spark, data)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    assert len(set(cols)) == len(cols) and rows
    if name in COLUMNS:
        assert cols == COLUMNS[name].split() and len(set(rows)) == len(rows)
    if name in SQL:
        con = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        r = con.execute(SQL[name])
        names = [x[0] for x in r.description]
        want = [tuple(x[names.index(c)] for c in cols) for x in r.fetchall()]
        assert sorted(names) == cols and sorted(rows, key=repr) == sorted(want, key=repr)
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)
