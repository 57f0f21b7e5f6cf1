import pytest

from tests.oracle import same
from weftline.plans import catalogue

CHECKED = sorted(catalogue.ORACLE_SQL)
UNCHECKED = sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL))


@pytest.mark.parametrize("name", CHECKED)
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    same(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", UNCHECKED)
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_module_lists_every_query(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_in_the_library_needs_the_optional_subpackage():
    import pathlib
    import re

    root = pathlib.Path(catalogue.__file__).parent.parent
    for f in root.rglob("*.py"):
        if f.relative_to(root).parts[0] != "llm":
            assert not re.search(r"weftline\.llm|corpus_pipeline", f.read_text()), f
