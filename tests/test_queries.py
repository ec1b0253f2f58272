"""Every registered query against its SQL."""

import pytest

import __spark_entry__
from tessella.plans import registry

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(name, spark, sf_dir, duck):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_only_the_entry_module_knows_the_optional_subpackage():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    outside = [p for p in (root / "tessella").rglob("*.py") if "llm" not in p.relative_to(root / "tessella").parts]
    assert not [p for p in outside if "llm" in p.read_text()]
