"""The entry point: the flagship runs, and every SQL twin names the columns of its query."""

import ast
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.schema == __spark_entry__.entry(spark).schema


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "tarkash").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("tarkash.llm") for n in names), path


@pytest.mark.parametrize("module", __spark_entry__._parts(), ids=lambda m: m.__name__)
def test_results_equal_the_sql(spark, module):
    duckdb = pytest.importorskip("duckdb")
    folder = Path("/root/testdata/sf0.001")
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    plain = lambda v: round(v, 5) if isinstance(v, float) else round(float(v), 5) if type(v).__name__ == "Decimal" else v.isoformat() if hasattr(v, "isoformat") else v
    for name, sql in module.oracle_sql().items():
        df = module.queries()[name](spark, str(folder))
        columns = sorted(df.columns)
        ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        cursor = con.execute(sql)
        order = [d[0] for d in cursor.description]
        theirs = sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
        assert sorted(order) == columns and ours == theirs, name
