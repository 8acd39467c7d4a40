import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
for folder in (HERE, os.path.dirname(HERE)):
    sys.path.insert(0, folder)
# one process is driver and executors of all tests: in 1 GB, Spark's default, test_units.py in file order ended it
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 3g pyspark-shell")


@pytest.fixture(scope="session")
def spark():
    from sagebrush.session import get_session

    s = get_session("local[*]", 8)
    s.sparkContext.setLogLevel("OFF")
    yield s
