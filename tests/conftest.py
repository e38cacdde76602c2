import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from quarrymill.session import local_session

    session = local_session(cores="4", partitions=4, memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
