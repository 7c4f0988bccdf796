import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewatch.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    return local_session("4", **{"spark.checkpoint.dir": shared, "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})


def at(text):
    return datetime.datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def series(spark):
    """(sensor_id, ts, value, seq) from (sensor, minutes or ISO text, value) triples."""

    def build(rows, start="2024-01-01 00:00:00"):
        origin = at(start)
        out = []
        for i, (sensor, when, value) in enumerate(rows):
            ts = at(when) if isinstance(when, str) else origin + datetime.timedelta(minutes=when)
            out.append((sensor, ts, value, i))
        return spark.createDataFrame(out, "sensor_id string, ts timestamp, value double, seq bigint")

    return build
