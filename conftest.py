import time

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def finish(query, rows, seconds=120):
    """Stop a stream once it has read so many rows and written what came of them. A stream with timers runs batches
    without data for ever, so there is no end to wait for."""
    until = time.time() + seconds
    while query.isActive and sum(p["numInputRows"] for p in query.recentProgress) < rows:
        assert time.time() < until, query.status
        time.sleep(0.2)
    query.stop()
    if query.exception():
        raise query.exception()


@pytest.fixture()
def finished():
    return finish
