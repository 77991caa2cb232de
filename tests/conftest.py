import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnsift.plans.timeline import BLOCKS  # noqa: E402
from turnsift.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="turnsift-tests-"),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "blocked"])
def mode(request, spark):
    """Run a test in one block and with every key cut into blocks."""
    spark.conf.set(BLOCKS, "7" if request.param == "blocked" else "1")
    yield request.param
    spark.conf.unset(BLOCKS)


@pytest.fixture
def log(spark):
    """Messages from (seconds, role, content) tuples; options: platform and convo per row."""
    from pyspark.sql import functions as F

    def make(rows, platform="claude", convo="c1"):
        data = []
        for seq, row in enumerate(rows):
            extra = row[3] if len(row) > 3 else {}
            data.append((extra.get("convo", convo), seq, float(row[0]), extra.get("platform", platform), row[1], row[2],
                         extra.get("urls", []), extra.get("historical", False)))
        df = spark.createDataFrame(
            data, "convo_id string, seq long, t double, platform string, role string, content string, "
            "urls array<string>, historical boolean")
        return df.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long") + 1_704_067_200_000_000))

    return make
