import datetime as dt

import pytest

from tidemark.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8", partitions=4, memory="6g")


@pytest.fixture
def day():
    """``day(n)``: the n-th day after 2020-01-01."""
    return lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.fixture
def rows():
    """The rows of a frame as sorted tuples of the named columns."""

    def take(df, *columns):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))

    return take
