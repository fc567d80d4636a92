import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

FILE, DIR, LINK = "FS_FILE_TYPE_FILE", "FS_FILE_TYPE_DIRECTORY", "FS_FILE_TYPE_SYMLINK"
ENTRY = ("path string, type string, id string, size bigint, datablocks bigint, metablocks bigint, owner string, "
         "`group` string, creation_time timestamp, modification_time timestamp, access_time timestamp, "
         "change_time timestamp, child_count bigint, extended_attributes struct<hidden:boolean,archive:boolean>")


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Inventory rows from (path, {column: value}) pairs; a path ending in / is a directory."""
    names = [f.strip().split(" ")[0].strip("`") for f in ENTRY.split(", ")]
    when = datetime(2001, 1, 1)

    def build(*rows):
        table = []
        for row in rows:
            path, given = row if isinstance(row, tuple) else (row, {})
            base = {"path": path.rstrip("/"), "type": DIR if path.endswith("/") else FILE, "id": path, "size": 10,
                    "owner": "o", "group": "g", "creation_time": when, "modification_time": when,
                    "access_time": when, "change_time": when}
            base.update(given)
            table.append(tuple(base.get(n) for n in names))
        return spark.createDataFrame(table, ENTRY)

    return build


def column(frame, name="path"):
    return sorted(r[name] for r in frame.select(name).collect())


def pairs(frame, *names):
    return {tuple(r) for r in frame.select(*names).collect()}
