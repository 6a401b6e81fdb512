import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "2").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def log(spark):
    """Build an event frame from short dicts; seq is the place in the list."""
    import json

    from vidimus import schemas

    names = [p.split(" ")[0] for p in schemas.EVENT_DDL.split(", ")]

    def build(*events, start=0):
        rows = []
        for i, e in enumerate(events):
            e = {"seq": start + i, "authored_by": "agent:a", "at": f"t{start + i:04d}", **e}
            e["detail"] = json.dumps(e.get("detail", {}))
            rows.append(tuple(e.get(n) for n in names))
        return spark.createDataFrame(rows, schemas.EVENT_DDL)

    return build
