"""Every query of the library against its SQL on the smallest tables; those without SQL give rows."""

import pytest
from compare import differences, duck

from clipflow.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert not differences(df, con, ORACLES[name])
    else:
        assert df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_imports_the_corpus_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "clipflow"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
