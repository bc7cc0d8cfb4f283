"""Rows that an order leaves tied: the first in the table stays, whatever Spark reads first, as in DuckDB on one thread."""

import os
import tempfile
from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from touchline.plans import catalog

COLUMNS = ["session_id", "task_type", "line", "part", "status"]


@pytest.mark.parametrize("name", ["snapshot_then_tail", "stored_upsert"])
def test_tied_lines(spark, name):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.mkdir(f"{folder}/lineitem.parquet")
    for k, ids in enumerate((range(3000), range(3000, 20_000))):  # Spark reads the larger file first
        rows = [{"l_orderkey": i % 100, "l_partkey": i, "l_linenumber": i % 7 + 1, "l_returnflag": "AN"[i % 2], "l_linestatus": "O", "l_shipdate": datetime(2000, 1, 1)} for i in ids]
        kinds = pa.schema({"l_orderkey": pa.int64(), "l_partkey": pa.int64(), "l_linenumber": pa.int32(), "l_returnflag": pa.string(), "l_linestatus": pa.string(), "l_shipdate": pa.timestamp("us")})
        pq.write_table(pa.Table.from_pylist(rows, kinds), f"{folder}/lineitem.parquet/{k}.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    for table, path in {"lineitem": f"{folder}/lineitem.parquet/*.parquet", **{t: f"/root/testdata/sf0.001/{t}.parquet" for t in ("events", "orders")}}.items():
        con.execute(f"create view {table} as select * from read_parquet('{path}')")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({catalog.oracle_sql()[name]})").fetchall()
    found = catalog.queries()[name](spark, folder).select(COLUMNS).collect()
    assert sorted(map(tuple, found)) == sorted(want)
