import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from terravane.session import build

    s = build(app="tests", master="local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g", spark_driver_host="127.0.0.1", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
