import os

import pytest

DATA = os.environ.get("SPOKEWISE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def sf():
    """A folder of small tables."""
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def sf_more():
    return f"{DATA}/sf0.01"
