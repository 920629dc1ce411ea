"""Intermediate tables: where they go, and that they come back whole."""

import pytest

from sluice.llm import staging


class Bare:
    """A session without the setting."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "local[2]"

        @staticmethod
        def getConf():
            return Bare.conf


def test_folder(spark, monkeypatch):
    assert staging.folder(spark).startswith("file:")
    own = staging.folder(Bare)
    assert own.startswith("file:///") and staging.folder(Bare) == own
    monkeypatch.setattr(Bare.sparkContext, "master", "spark://somewhere:7077")
    with pytest.raises(ValueError):
        staging.folder(Bare)


def test_settle(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "x long, y string")
    back = staging.settle(df, "t")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr) and back.schema == df.schema
    assert "Scan" in back._jdf.queryExecution().toString() and staging.settle(df.limit(0), "t").count() == 0
