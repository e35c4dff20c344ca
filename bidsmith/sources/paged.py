"""A paged service as a Spark source: read once with filters sent to it, or polled as a stream of day windows."""

from __future__ import annotations

import datetime as dt
import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


class PagedSource(DataSource):
    """A paged service, with equality, membership and range filters sent to it.

    Options: fetch, "module:function" of (filters, page, size) that returns rows as tuples or None
    for "try again" (backed off, then tried again); schema, a DDL string; size, the rows of a full page;
    pause, seconds between a task's requests; backoff, seconds before the first new try, doubled for each further one; "filter.<name>", passed on as a filter. filters: {"column": values} and
    {"column >=": [value]} and so on.

    Read once: lanes, how many tasks read side by side (lane k reads pages k, k + lanes, ... until a short
    page); most, an exact limit of records the service gives (one lane only; filters that the service is lax about are
    checked by Spark after it); order, passed on as the filter "order".

    As a stream: since, the time (2024-01-31T12:00:00, UTC) before the first window; back, hours that a window reaches
    back before the last poll; now, the time of the poll (the clock's by default). Windows are of whole days, as the service
    files records by day, so they overlap; see PolledReader.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PolledReader(self.options)


def fixed(options: dict) -> dict[str, list]:
    """The filters that options give."""
    return {k.removeprefix("filter."): [v] for k, v in options.items() if k.startswith("filter.")}


def pages(options: dict, sent: dict[str, list], first: int = 0, step: int = 1, most: int = -1) -> Iterator[tuple]:
    """Rows of pages first, first + step, ... until a short one, `most` at most (negative: all)."""
    module, _, name = options["fetch"].partition(":")
    fetch = getattr(importlib.import_module(module), name)
    size, page, rows = int(options.get("size", 100)), first, None
    while most and (rows is None or len(rows) >= size):
        if rows is not None:
            time.sleep(float(options.get("pause", 0)))
        rows = list(retried(lambda: fetch(sent, page, size), pause=float(options.get("backoff", 10))))  # noqa: B023
        yield from rows if most < 0 else rows[:most]
        most -= min(most, len(rows)) if most > 0 else 0
        page += step


class PagedReader(DataSourceReader):
    RANGES = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, options):
        self.options, self.sent = options, fixed(options)
        if "order" in options:
            self.sent["order"] = [options["order"]]
        if "most" in options and int(options.get("lanes", 1)) > 1:
            raise ValueError("a limit of records needs one lane")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo):
                self.sent[".".join(f.attribute)] = [f.value]
            elif isinstance(f, In):
                self.sent[".".join(f.attribute)] = list(f.value)
            elif type(f) in self.RANGES:
                self.sent[f"{'.'.join(f.attribute)} {self.RANGES[type(f)]}"] = [f.value]
            yield f  # Spark checks again: a service may be lax

    def partitions(self):
        return [InputPartition(p) for p in range(int(self.options.get("lanes", 1)))]

    def read(self, partition) -> Iterator[tuple]:
        return pages(self.options, self.sent, partition.value, int(self.options.get("lanes", 1)), int(self.options.get("most", -1)))


@dataclass
class DayWindow(InputPartition):
    """One day's records as the service shows them at a time."""

    day: str
    until: str


class PolledReader(DataSourceStreamReader):
    """A poll is an offset, its time. A batch reads the days from that of the last poll (less `back` hours) to that of this one,
    a task a day, so catching up after a pause is as wide as the pause is long.

    The filters day and until go to the service. Offsets are in the stream's checkpoint before a batch runs: a batch
    that is run again asks for the same days as of the same time. Days overlap, so what follows must know
    the records it has had (`streaming.polling.poll`).
    """

    def __init__(self, options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"until": self.options["since"]}

    def latestOffset(self) -> dict:
        now = self.options.get("now") or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
        return {"until": max(now, self.options["since"])}

    def partitions(self, start: dict, end: dict) -> list[DayWindow]:
        if start["until"] >= end["until"]:
            return []
        first = (dt.datetime.fromisoformat(start["until"]) - dt.timedelta(hours=float(self.options.get("back", 1)))).date()
        last = dt.datetime.fromisoformat(end["until"]).date()
        return [DayWindow((first + dt.timedelta(days=k)).isoformat(), end["until"]) for k in range((last - first).days + 1)]

    def read(self, partition: DayWindow) -> Iterator[tuple]:
        return pages(self.options, {**fixed(self.options), "day": [partition.day], "until": [partition.until]})


def retried(call: Callable, attempts: int = 5, pause: float = 10.0, wait: Callable[[float], None] | None = None):
    """call's rows; None means that the service is busy: wait pause * 2 ** n and try again, at most so often."""
    for n in range(attempts):
        if (rows := call()) is not None:
            return rows
        if n + 1 < attempts:
            (wait or time.sleep)(pause * 2**n)
    raise TimeoutError(f"no answer after {attempts} attempts")


def paged_table(spark: SparkSession, fetch: str, schema: str, columns: list[str] | None = None, **options) -> DataFrame:
    """The service as a table. columns: the projection, sent as the filter "columns"; no other column is asked for.

    Lets Spark send filters to Python sources in this session.
    """
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    fields = StructType.fromDDL(schema)
    if columns:
        fields = StructType([fields[c] for c in columns])
        options["filter.columns"] = ",".join(columns)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return spark.read.format("paged").options(fetch=fetch, schema=ddl, **options).load()


def paged_stream(spark: SparkSession, fetch: str, schema: str, since: str, **options) -> DataFrame:
    """The service polled as a stream."""
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("paged").options(fetch=fetch, schema=schema, since=since, **options).load()


@lru_cache(maxsize=4)
def _answer(asked: str) -> list[tuple]:
    import pyarrow.compute as pc
    import pyarrow.dataset as ds
    import pyarrow.fs

    filters = json.loads(asked)
    where, path = pyarrow.fs.FileSystem.from_uri(filters.pop("folder")[0])
    table = ds.dataset(path, filesystem=where, format="parquet", partitioning=ds.partitioning(pa.schema([("day", pa.string())]), flavor="hive"))
    order, columns = filters.pop("order", [None])[0], filters.pop("columns", [None])[0]
    keep = None
    for name, values in filters.items():
        column, _, mark = name.partition(" ")
        c = pc.field("seen" if name == "until" else column)
        if name == "until":
            one = c <= values[0]
        elif mark:
            one = {">": c > values[0], ">=": c >= values[0], "<": c < values[0], "<=": c <= values[0]}[mark]
        else:
            one = c.isin(values)
        keep = one if keep is None else keep & one
    names = columns.split(",") if columns else [n for n in table.schema.names if n not in ("day", "seen")]
    by = [(o.removeprefix("-"), "descending" if o.startswith("-") else "ascending") for o in (order.split(",") if order else ())]
    found = table.to_table(columns=list(dict.fromkeys([*names, *(o for o, _ in by)])), filter=keep)
    if by:
        found = found.sort_by(by)
    return list(zip(*(c.to_pylist() for c in found.select(names).columns), strict=True))


def folder_page(filters: dict[str, list], page: int, size: int) -> list[tuple]:
    """A service kept as Parquet files by day (folder/day=2024-01-31/...): the filters folder (a URI), day, order (columns; "-" before one: descending),
    columns and until (records with `seen` at or before it), and equality, membership and ranges of any column."""
    return _answer(json.dumps(filters, sort_keys=True, default=str))[page * size : (page + 1) * size]
