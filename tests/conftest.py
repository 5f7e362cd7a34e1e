import pytest

from tidemill.plans.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session(
        "tidemill-tests",
        master="local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_groups(spark):
    """Force the large-group paths onto tiny data."""
    spark.conf.set("tidemill.groupRows", "20")
    yield 20
    spark.conf.unset("tidemill.groupRows")


@pytest.fixture
def row_limit(spark):
    """Set how many rows a group may have before it counts as large."""
    yield lambda n: spark.conf.set("tidemill.groupRows", str(n))
    spark.conf.unset("tidemill.groupRows")
