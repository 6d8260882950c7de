import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from gridloom.session import session

    own = session("tests", "local[4]", 4, spark_ui_enabled="false", spark_driver_memory="4g", spark_ui_showConsoleProgress="false", spark_sql_adaptive_coalescePartitions_enabled="true")
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"
