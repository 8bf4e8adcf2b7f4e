"""Every registered query against its SQL, or at least to its end."""

import pytest

from compare import assert_same
from murmura.plans import registry

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    if name in registry.oracle_sql():
        assert_same(df, duck.sql(registry.oracle_sql()[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_training_data_operators(monkeypatch):
    import importlib.util

    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "murmura.llm" else real(name, *a))
    assert not any(q.startswith("op") and q[2].isdigit() for q in __spark_entry__.queries())
