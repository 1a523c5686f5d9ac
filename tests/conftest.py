import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wherewhen.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "wherewhen-tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a column function to a list of values in one job."""
    from pyspark.sql import functions as F

    def run(function, values, schema="v string"):
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i long, {schema}")
        names = [c for c in frame.columns if c != "i"]
        out = frame.select("i", function(*[F.col(c) for c in names]).alias("out")).orderBy("i").collect()
        return [r["out"] for r in out]

    return run
