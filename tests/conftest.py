import os

import pytest

from lingualoom.session import build_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return DATA


@pytest.fixture(scope="session", autouse=True)
def one_grid(request):
    """Queries that evaluate the same grid of matches share one run of it."""
    from lingualoom.plans import pages, similarity
    from lingualoom.session import materialise

    real, kept = similarity.grid_matches, {}

    def once(spark, folder, *grid):
        if (folder, grid) not in kept:
            inputs, found = real(spark, folder, *grid)
            kept[folder, grid] = inputs, materialise(found, "grid_of_tests")
        return kept[folder, grid]

    similarity.grid_matches = pages.grid_matches = once
    yield
    similarity.grid_matches = pages.grid_matches = real
