"""Compare queries with their SQL: ``python -m checks.compare SF_DIR [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import build
from checks.queries import CATALOGUE


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tidy(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """Empty if both hold the same rows."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    ours, theirs = tidy(ours), tidy(theirs)
    for column in ours.columns:
        a, b = ours[column], theirs[column]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = same.idxmin()
            return f"{(~same).sum()} values of {column}, first {ours.loc[i].to_dict()} vs {theirs.loc[i].to_dict()}"
    types = [(c, str(ours[c].dtype), str(theirs[c].dtype)) for c in ours.columns]
    odd = [t for t in types if t[1] != t[2]]
    return f"types {odd}" if odd else ""


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(CATALOGUE)
    spark, con, sql = session(), connect(sf_dir), build()
    wrong = 0
    for name in names:
        try:
            start = time.perf_counter()
            ours = CATALOGUE[name](spark, sf_dir).toPandas()
            spent = time.perf_counter() - start
            if name not in sql:
                verdict = "no SQL"
            else:
                verdict = difference(ours, con.execute(sql[name]).df()) or "ok"
        except Exception as error:  # report and go on with the other queries
            spent, ours, verdict = 0, [], f"{type(error).__name__} {str(error)[:400]}"
        wrong += verdict not in ("ok", "no SQL")
        print(f"{name:32s} {spent:7.2f}s {len(ours):8d} rows  {verdict}", flush=True)
    print(f"{wrong} of {len(names)} differ")


if __name__ == "__main__":
    main()
