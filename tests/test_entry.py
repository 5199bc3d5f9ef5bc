"""The registry: names, schemas and, on the smallest tables, the same rows as DuckDB."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from corpusloom.plans import registry

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def normal(rows):
    def value(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@here
@pytest.mark.parametrize("name", [n for n in registry.QUERIES])
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    assert rows
    if name in registry.ORACLES:
        import duckdb

        con = duckdb.connect()
        for f in Path(DATA).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*' if f.is_dir() else ''}')")
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name].strip()})").fetchall()
        assert normal(rows) == normal(want)


@here
def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "pos", "content"]


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_llm_folder(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; q = e.queries(); assert 'chunk_fixed_512_50' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    copy = tmp_path / "corpusloom"
    for f in (root / "corpusloom").rglob("*.py"):
        if "llm" not in f.parts:
            to = copy / f.relative_to(root / "corpusloom")
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_llm_folder():
    root = Path(__file__).resolve().parent.parent / "corpusloom"
    assert not [f for f in root.rglob("*.py") if "llm" not in f.relative_to(root).parts and "llm" in f.read_text().replace("llm_", "").replace("_llm", "")]
