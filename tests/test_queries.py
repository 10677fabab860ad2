"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import pytest

from tarnwell.plans import registry

from .compare import duck_rows, rows_of
from .conftest import SMALL


#: Queries without SQL; each has a test of its own.
NO_SQL = {"f22_hashes"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - NO_SQL))
def test_query_equals_sql(spark, duck, name):
    sql = registry.oracle_sql()
    assert name in sql
    assert rows_of(registry.queries()[name](spark, SMALL)) == duck_rows(duck, sql[name])


def test_hashes(spark):
    import zlib

    import xxhash

    for r in registry.queries()["f22_hashes"](spark, SMALL).collect():
        assert r.crc == zlib.crc32(r.p_name.encode()) and r.xx % 2**64 == xxhash.xxh64_intdigest(r.p_name.encode(), 42)
        assert len(r.sound) == 4 and r.sound[0] == r.p_type[0].upper() and r.sound[1:].isdigit()


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
