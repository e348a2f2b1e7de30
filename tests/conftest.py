from __future__ import annotations

import pytest

from symloom.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", 4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
