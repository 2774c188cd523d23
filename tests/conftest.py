import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from packloom.session import local_session

    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from packloom.catalog import Tables

    from .compare import ROOT

    return Tables(spark, f"{ROOT}/sf0.001")
