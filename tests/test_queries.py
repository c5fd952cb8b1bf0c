"""Every query of the array catalogue against its SQL in DuckDB, and the driver's contract."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from arrayloom.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.12g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_agrees_with_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    sql = catalogue.ORACLES[name]
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(plain, map(tuple, got.select(*columns).collect())))) == sorted(map(repr, map(plain, want)))
    assert len(duck.execute(f"DESCRIBE {sql}").fetchall()) == len(columns)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 800
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_imports_without_the_optional_parts(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "arrayloom", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "arrayloom").mkdir()
    for p in (ROOT / "arrayloom").iterdir():
        if p.name != "llm":
            (tmp_path / "arrayloom" / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    names = said.stdout.split()
    assert "region_f64" in names and not any(n.startswith("op1") or n == "pipeline" for n in names)
