"""Every query against its SQL counterpart at the smallest scale factor."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.compare import differences, duck
from checks.oracles import all_oracles
from checks.queries import _streamed, all_queries
from eventlens.operators.quality import leaked_identifiers
from eventlens.sources import tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", list(all_oracles()))
def test_query_equals_sql(spark, connection, name):
    assert differences(spark, connection, SF, name) is None


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize(
    "name", [n for n in all_queries() if n.split("_")[0] in {"sessions", "popularity", "summary", "retention", "custom"}]
)
def test_metric_results_hold_no_identifier(spark, name):
    assert leaked_identifiers(all_queries()[name](spark, SF)) == []


def test_landings_of_a_stream_are_written_by_all_tasks(spark, tmp_path):
    """A landing is one micro-batch of many files, not one file that a single task has to write."""
    rows = spark.range(0, 400, 1, 8).select("id", F.timestamp_seconds(F.col("id") * 60).alias("at"))
    seen = []

    def start(stream):
        def land(batch, number):
            seen.append((number, batch.count()))

        writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{tmp_path}/state")
        return writer.trigger(availableNow=True).start()

    _streamed([rows.filter("id < 200"), rows.filter("id >= 200")], str(tmp_path), start)
    assert seen == [(0, 200), (1, 200)]
    assert len(list(tmp_path.glob("in/*.parquet"))) >= 8


def test_codes_are_written_before_they_are_filtered(spark, monkeypatch):
    """Else the filter on the code is moved below the checks, which then run once for every use."""
    staged, stage = [], tables.stage
    monkeypatch.setattr(tables, "stage", lambda df, name: staged.append(df.columns) or stage(df, name))
    all_queries()["ingest_rejects"](spark, SF)
    assert ["batch_id", "code"] in staged
