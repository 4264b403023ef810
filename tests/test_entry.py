"""The driver contract: registered queries against their SQL twins, and imports without the optional parts."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical_rows(rows, columns):
    def text(x):
        return repr(round(x, 5) + 0.0) if isinstance(x, float) else str(x)

    return sorted(tuple(text(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in rows)


def names():
    from strandloom import matrix_queries, queries, search_queries

    assert matrix_queries and search_queries
    return sorted(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", names())
def test_query_matches_its_sql(spark, data_dir, name):
    import duckdb

    from strandloom import matrix_queries, queries, search_queries

    assert matrix_queries and search_queries

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data_dir}/{table}.parquet')")
    result = connection.execute(queries.ORACLE_SQL[name])
    want = canonical_rows(result.fetchall(), [c[0] for c in result.description])
    frame = queries.QUERIES[name](spark, data_dir)
    assert canonical_rows(map(tuple, frame.collect()), frame.columns) == want


def test_import_without_optional_parts(tmp_path):
    for part in ("strandloom", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{part}", tmp_path / part) if part.endswith(".py") else None
    (tmp_path / "strandloom").mkdir()
    for part in os.listdir(f"{ROOT}/strandloom"):
        if part != "llm":
            os.symlink(f"{ROOT}/strandloom/{part}", tmp_path / "strandloom" / part)
    os.remove(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') or x == 'pipeline' for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
