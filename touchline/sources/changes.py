"""Change feed of tables as a streaming source: spark.readStream.format("touchline_changes").

Rows of Parquet folders that arrive as ``turn=N`` folders, each whole when its _SUCCESS is there.
An offset is the number of turns read, so a stream that is stopped goes on with the
next turn and replays a turn as a whole. Each file of a turn is a partition that a task reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow.parquet as pq
from pyarrow import RecordBatch
from pyarrow import compute as pc
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "touchline_changes"


class ChangedFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ChangeReader(DataSourceStreamReader):
    """Options: path; key and value of a filter (value compared as text); turns_each, the most turns of a batch (all)."""

    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.options = options
        self.at = 0

    def _store(self) -> tuple[pafs.FileSystem, str]:
        path = re.sub(r"^file:/+", "/", self.options["path"])
        return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)

    def _files(self, turn: int) -> list[str] | None:
        """Files of a turn; none before it is whole."""
        store, path = self._store()
        found = store.get_file_info(pafs.FileSelector(f"{path}/turn={turn}", allow_not_found=True))
        names = [f.path for f in found]
        return sorted(n for n in names if n.endswith(".parquet")) if any(n.endswith("/_SUCCESS") for n in names) else None

    def initialOffset(self) -> dict:
        return {"turn": 0}

    def latestOffset(self) -> dict:
        turn, most = self.at, int(self.options.get("turns_each", 1 << 30))
        while turn - self.at < most and self._files(turn) is not None:
            turn += 1
        self.at = turn
        return {"turn": turn}

    def partitions(self, start: dict, end: dict) -> list[ChangedFile]:
        self.at = max(self.at, end["turn"])
        return [ChangedFile(path) for turn in range(start["turn"], end["turn"]) for path in self._files(turn) or []]

    def read(self, partition: ChangedFile) -> Iterator[RecordBatch]:
        store, _ = self._store()
        key, value = self.options.get("key"), self.options.get("value")
        for batch in pq.ParquetFile(store.open_input_file(partition.path)).iter_batches(columns=self.names):
            if key:
                batch = batch.filter(pc.equal(batch.column(batch.schema.get_field_index(key)).cast("string"), value))
            if batch.num_rows:
                yield batch.select(self.names)

    def commit(self, end: dict) -> None:
        """Files belong to whoever wrote them; nothing is deleted."""


class ChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeSource)
