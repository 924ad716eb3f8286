"""A Python data source of simulated log rows, for batches and streams: format "eventlog"."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from brookmill.sources.simulate import Faults, Rates, log_rows

COLUMNS = "topic string, kafka_partition int, kafka_offset long, kafka_ts timestamp, key binary, value binary"


def _rows(options: dict) -> list[tuple]:
    from datetime import timedelta

    from brookmill.functions.avro import EPOCH

    number = lambda k, d: type(d)(options.get(k, d))
    faults = Faults(number("duplicate", 0.0), number("late", 0.0), number("malformed", 0.0), seed=number("seed", 1))
    rows, _ = log_rows(number("seed", 1), number("startms", 1_768_471_200_000), number("seconds", 60), Rates(sessions_per_second=number("rate", 5.0)), faults)
    return [(t, p, o, EPOCH + timedelta(milliseconds=ms), k, v) for t, p, o, ms, k, v in rows]


class EventLog(DataSource):
    """Options: seed, startms, seconds, rate, duplicate, late, malformed; streams also rowsperbatch."""

    @classmethod
    def name(cls) -> str:
        return "eventlog"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        return iter(_rows(self.options))


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.size, self.rows = options, int(options.get("rowsperbatch", 500)), None

    def _all(self) -> list[tuple]:
        if self.rows is None:
            self.rows = _rows(self.options)
        return self.rows

    def initialOffset(self) -> dict:
        return {"row": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(len(self._all()), start["row"] + self.size)
        return iter(self._all()[start["row"] : end]), {"row": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._all()[start["row"] : end["row"]])

    def commit(self, end: dict) -> None:
        pass
