"""Every query of the inventory's operators against its DuckDB oracle."""

from __future__ import annotations

import pytest

from tessera.plans import registry

from .compare import as_text, oracle_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), oracle_rows(registry.ORACLES[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert as_text(got) == as_text(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_payload_filter_reads_the_whole_table(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    events = spark.read.parquet(f"{sf}/events.parquet").where(F.get_json_object("props", "$.k") == "42")
    got = [r.event_id for r in registry.QUERIES["payload_filter_whole"](spark, sf).collect()]
    assert sorted(got) == sorted(r.event_id for r in events.collect()) and max(got) >= 5000


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
