"""The stored catalog is a lossless, reused copy of the derived tables."""

from __future__ import annotations

from opsframes import schemas as S
from opsframes.sources.catalog import catalog
from opsframes.sources.files import exists
from opsframes.sources.tables import load

from conftest import SF_SMALL


def test_stored_tables_equal_derived_tables(spark):
    stored, lazy = catalog(spark, SF_SMALL), load(spark, SF_SMALL)
    for name, schema in S.TABLE_SCHEMAS.items():
        a, b = getattr(stored, name), getattr(lazy, name)
        assert a.columns == schema.fieldNames() == b.columns, name
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_catalog_is_built_once_per_source(spark):
    assert catalog(spark, SF_SMALL) is catalog(spark, SF_SMALL + "/")
    assert catalog(spark, SF_SMALL).path.startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


def test_a_table_is_written_when_first_used(spark, tmp_path):
    src = tmp_path / "events.parquet"
    spark.read.parquet(f"{SF_SMALL}/events.parquet").limit(50).write.parquet(str(src))
    tables = catalog(spark, str(tmp_path))
    assert not exists(spark, tables.path)
    tables.alerts.count()
    assert exists(spark, f"{tables.path}/alerts") and not exists(spark, f"{tables.path}/logs")
    assert tables.recent("logs").count() <= tables.logs.count() == 50
    tables.build()
    assert all(exists(spark, f"{tables.path}/{n}") for n in S.TABLE_SCHEMAS)


def test_part_files_added_to_a_source_give_a_new_store(spark, tmp_path):
    src = tmp_path / "events.parquet"
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.where("event_id < 10").write.parquet(str(src))
    first = catalog(spark, str(tmp_path))
    assert first.logs.count() == 10 and catalog(spark, str(tmp_path)) is first
    events.where("event_id between 10 and 29").write.mode("append").parquet(str(src))
    assert catalog(spark, str(tmp_path)).logs.count() == 30
