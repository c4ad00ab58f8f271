from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tools_compare import rows as shown

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in Path(small).iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, small, name):
    got, want = entry.queries()[name](spark, small).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and shown(got) == shown(want)


@pytest.mark.parametrize("rows, blanks", [(0, 0), (20, 15)])
def test_every_query_on_odd_tables(spark, small, tmp_path, rows, blanks):
    """Empty tables, and tables of which many rows are NULL in every column."""
    for p in Path(small).iterdir():
        t = ds.dataset(p).to_table().slice(0, rows)
        t = pa.concat_tables([t, pa.table({c: pa.nulls(blanks, t.schema.field(c).type) for c in t.column_names})])
        pq.write_table(t, tmp_path / p.name)
    for name, q in entry.queries().items():
        assert q(spark, str(tmp_path)).count() >= 0, name


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "status" in df.columns


def test_every_query_plans(spark, small):
    for name, q in entry.queries().items():
        assert q(spark, small).columns, name


def test_core_does_not_need_the_subpackage():
    core = [p for p in (ROOT / "tessera").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert not [p for p in core if "tessera.llm" in p.read_text()]
    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
