import pytest


@pytest.fixture(scope="session", autouse=True)
def leave_nothing_behind(spark):
    yield
    from graphloom.llm._common import clear

    clear(spark)
