"""Price histories through Spark's Python data sources: one format, any provider, partitions by series and year.

    spark.dataSource.register(PriceHistory)
    spark.read.format("price_history").option("provider", "csv").option("path", folder).load()

A provider tells which parts it has and reads one; the format deals parts to tasks and leaves out those that filters on
series and date exclude. Providers are named in PROVIDERS, or given as module:class.
"""

from __future__ import annotations

import csv
import datetime as dt
import importlib
import io
import threading
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

_registering = threading.Lock()
SCHEMA = "series string, d date, close double"


@dataclass(frozen=True)
class Part(InputPartition):
    """One year of one series, and where a provider has it."""

    series: str
    year: int
    place: str


class Provider:
    """Where histories come from. Prices that are not positive numbers are left out by the format."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def parts(self) -> list[Part]:
        raise NotImplementedError

    def read(self, part: Part) -> Iterable[tuple[dt.date | None, float | None]]:
        raise NotImplementedError


class _Folders(Provider):
    """Files in folders series=S/year=Y below the option `path`, on any store that pyarrow.fs opens."""

    def parts(self) -> list[Part]:
        store, base = pafs.FileSystem.from_uri(self.options["path"])
        found = []
        for x in store.get_file_info(pafs.FileSelector(base, recursive=True)):
            keys = dict(p.split("=", 1) for p in x.path.split("/") if "=" in p)
            if x.is_file and x.size and not x.base_name.startswith(("_", ".")) and keys.keys() >= {"series", "year"}:
                found.append(Part(unquote(keys["series"]), int(keys["year"]), x.path))
        return sorted(found, key=lambda p: p.place)

    def _open(self, part: Part) -> pa.NativeFile:
        return pafs.FileSystem.from_uri(self.options["path"])[0].open_input_file(part.place)


class CsvHistory(_Folders):
    """Lines `date,close`, without a header."""

    def read(self, part: Part) -> Iterator[tuple[dt.date | None, float | None]]:
        def number(x: str) -> float | None:
            try:
                return float(x)
            except ValueError:
                return None

        with self._open(part) as file, io.TextIOWrapper(file, encoding="utf-8") as lines:
            for row in csv.reader(lines):
                if len(row) == 2:
                    yield dt.date.fromisoformat(row[0][:10]) if row[0] else None, number(row[1])


class ParquetHistory(_Folders):
    """Parquet files with the columns d and close."""

    def read(self, part: Part) -> Iterator[tuple[dt.date | None, float | None]]:
        with self._open(part) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=["d", "close"]):
                yield from zip(batch.column("d").to_pylist(), batch.column("close").to_pylist(), strict=True)


PROVIDERS: dict[str, type[Provider]] = {"csv": CsvHistory, "parquet": ParquetHistory}


def provider(options: dict[str, str]) -> Provider:
    name = options.get("provider", "parquet")
    if name in PROVIDERS:
        return PROVIDERS[name](options)
    module, _, kind = name.partition(":")
    if not kind:
        raise ValueError(f"no provider {name}; there are {', '.join(PROVIDERS)}, or module:class")
    return getattr(importlib.import_module(module), kind)(options)


def _kept(part: Part, f: Filter) -> bool:
    """Whether a part can hold rows that pass a filter."""
    first, last = dt.date(part.year, 1, 1), dt.date(part.year, 12, 31)
    if f.attribute == ("series",):
        return part.series == f.value if isinstance(f, EqualTo) else part.series in f.value
    return {
        EqualTo: lambda v: first <= v <= last, In: lambda v: any(first <= x <= last for x in v),
        GreaterThan: lambda v: last > v, GreaterThanOrEqual: lambda v: last >= v, LessThan: lambda v: first < v, LessThanOrEqual: lambda v: first <= v,
    }[type(f)](f.value)


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.filters = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Filters on series by value and on the date by range choose parts; those on the date stay with Spark as well."""
        for f in filters:
            dated = f.attribute == ("d",) and isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)
            named = f.attribute == ("series",) and isinstance(f, EqualTo | In)
            if dated or named:
                self.filters.append(f)
            if not named:
                yield f

    def partitions(self) -> list[Part]:
        # Spark wants one part at least
        return [p for p in provider(self.options).parts() if all(_kept(p, f) for f in self.filters)] or [Part("", 0, "")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.place:
            for d, close in provider(self.options).read(partition):
                if d is not None and close is not None and 0 < close < float("inf"):
                    yield partition.series, d, close


class PriceHistory(DataSource):
    """Columns series, d, close; options: provider, and what the provider needs (path)."""

    @classmethod
    def name(cls) -> str:
        return "price_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:  # noqa: ANN001
        return HistoryReader(dict(self.options))


def read_history(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """Histories of a provider; filters on series and d reach it."""
    with _registering:  # registering is replacing, which must not happen twice at once
        spark.dataSource.register(PriceHistory)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("price_history").options(provider=name, **options).load()


def write_history(prices: DataFrame, path: str, name: str = "parquet") -> None:
    """Prices (series, d, close) in the folders that the providers `csv` and `parquet` read."""
    rows = prices.select("series", F.year("d").alias("year"), "d", "close")
    rows.repartition("series", "year").write.partitionBy("series", "year").format(name).save(path)
