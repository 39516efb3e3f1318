"""Comparing a query's rows with those of its SQL."""

from __future__ import annotations

import datetime
import subprocess
import sys
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def from_sql(sql, sf_dir=SF):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        if path.exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    found = con.sql(sql)
    return sorted(found.columns), rows_of(found.columns, found.fetchall())


def from_spark(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


_ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
spark = spark.config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
for name in {names!r}:
    __spark_entry__.queries()[name](spark, {sf!r}).write.format("noop").mode("overwrite").save()
    print("done", name)
"""


def from_elsewhere(folder, names):
    """The queries that run through in a session started in another folder, whose workers do not find this repository."""
    code = _ELSEWHERE.format(root=str(Path(__file__).parent.parent), shared=str(folder), names=names, sf=SF)
    ran = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=900)
    return [line.removeprefix("done ") for line in ran.stdout.splitlines() if line.startswith("done ")]
