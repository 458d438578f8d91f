"""Every registered query that has SQL gives the rows of its SQL; the others run."""

import compare
import pytest

from glimmer.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    said, good = compare.check(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert good, said


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10


def test_query_strings_of_letters_without_a_capital(spark, tmp_path):
    """A sharp s, a ligature, wide letters, empty words and blanks only: as in SQL."""
    texts = ["a b erersspf erersßpf erersßpf x", "a b c d straße STRASSE ﬁsch Ökö 😀ß", "ß", "", "  ", "a  b  ß  SS", None]
    spark.createDataFrame(list(enumerate(texts * 3)), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    said, good = compare.check(spark, compare.duck(str(tmp_path)), "query_strings", QUERIES["query_strings"], ORACLES["query_strings"], str(tmp_path))
    assert good, said
