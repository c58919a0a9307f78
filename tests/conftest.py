import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from zonelytics.session import configure, local_session

    folders = {"spark.checkpoint.dir": "shared", "spark.sql.warehouse.dir": "warehouse"}
    session = local_session("tests", cores=8, shuffle=8, extra={k: str(tmp_path_factory.mktemp(v)) for k, v in folders.items()})
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def frame(spark):
    """DataFrame from rows; columns named ``timestamp`` or ending in ``_time`` are parsed."""
    from pyspark.sql import functions as F

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        for c in df.columns:
            if (c == "timestamp" or c.endswith("_time")) and dict(df.dtypes)[c] == "string":
                df = df.withColumn(c, F.to_timestamp(c))
        return df

    return make
