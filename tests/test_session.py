from __future__ import annotations

import pytest

from splitproof import session


def test_written_tables_can_be_forgotten(spark):
    session.forget(spark)
    rows = session.written(spark.range(5), "five")
    assert rows.count() == 5 and session.forget(spark) == 1
    with pytest.raises(Exception, match="(?i)not.exist|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(rows.inputFiles()[0]).count()


def test_shared_folder_follows_the_session(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
