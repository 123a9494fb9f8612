"""Every declared plan against an independent engine, on relations that exercise its rules; the procedures' results aren't empty."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy import plans
from colloquy.domain import relations, with_relations
from colloquy.dialect import DUCK
from colloquy.plans import procedures

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    """As a driver would compare: nine places of a number."""
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9f}"
    return "[" + ",".join(map(shown, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.catalog()))
def test_plan(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    cursor = duck.execute(plans.oracle(name))
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted("|".join(shown(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted("|".join(shown(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want
    assert want, "a plan without rows shows nothing"


@pytest.mark.parametrize("name", sorted(procedures.QUERIES))
def test_procedure_runs(spark, sf_dir, name):
    assert procedures.QUERIES[name](spark, sf_dir).limit(5).collect()


def test_relations_hold_all_rows_of_their_tables(duck):
    count = lambda sql: duck.execute(sql).fetchone()[0]
    rows = lambda name: count(with_relations(DUCK, f"SELECT count(*) FROM {name}"))
    assert rows("vectors") == count("SELECT count(*) FROM embeddings")
    assert rows("utterances") == rows("comments") == count("SELECT count(*) FROM conversations")
    assert rows("turns") == rows("words") == count("SELECT count(*) FROM events")
    assert rows("text_lines") == count("SELECT sum(len(string_split(text, chr(10)))) FROM documents")
    assert set(relations(DUCK)) >= {"recordings", "gold_pairs", "exemplars"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
