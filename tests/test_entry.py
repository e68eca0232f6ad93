"""The driver's contract, with the optional subpackage and without."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from larkspur.queries import ORACLE, QUERIES

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    key = lambda r: [(v is None, str(v)) for v in r]
    got, rows = sorted(map(tuple, df.select(*columns).collect()), key=key), sorted(db.sql(f"SELECT {names} FROM ({ORACLE[name]})").fetchall(), key=key)
    assert len(got) == len(rows)
    for g, w in zip(got, rows, strict=True):
        assert all(x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-9)) for x, y in zip(g, w, strict=True))


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('larkspur.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 40 and not any(k.startswith('op') for k in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
