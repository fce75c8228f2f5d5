"""Readers: tables, CSV, JSON rows, spreadsheets, JDBC, event adapters, and a paged remote service."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual, StringContains
from pyspark.sql.types import StructType

from lodestream.functions.text import blank_to_null
from lodestream.sources import xlsx
from lodestream.sources.xlsx import excel  # noqa: F401  one of the readers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_text(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, blanks for what is missing, headers trimmed."""
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    return df.toDF(*[c.strip() for c in df.columns]).na.fill("")


def json_rows(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence[Any]], schema: StructType | None = None) -> DataFrame:
    """A frame from ``{columns, rows}``. Types are inferred from all rows once; give a schema to pin them."""
    if schema is not None:
        return spark.createDataFrame([tuple(r) for r in rows], schema)
    return spark.createDataFrame([tuple(r) for r in rows], list(columns), samplingRatio=1.0)


def json_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def incremental(df: DataFrame, time_col: str, now: Column, hours: int = 48) -> DataFrame:
    """Rows of the last hours, as a range predicate that reaches the scan. Polls overlap; the sink is idempotent."""
    return df.where(F.col(time_col) >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def jdbc(spark: SparkSession, url: str, dbtable: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """A JDBC table; filters and columns are pushed into its query. Give partition options for parallel reads."""
    return spark.read.format("jdbc").options(url=url, dbtable=dbtable, pushDownPredicate="true", **(options or {})).load()


def optional_dimension(read: Callable[[], DataFrame], empty: DataFrame) -> DataFrame:
    """A dimension that a report can do without: if its source fails on opening, the empty frame."""
    try:
        return read()
    except Exception:  # noqa: BLE001  any source error means "not available now"
        return empty


# --- header discovery -------------------------------------------------------------------------------------------------


def _key(text: Any) -> str:
    return re.sub(r"[^a-z0-9]+", " ", str(text if text is not None else "").lower()).strip()


def header_row(rows: Sequence[Sequence[Any]], aliases: Mapping[str, Sequence[str]], within: int = 30, least: int = 2) -> int:
    """The row among the first that names most known columns; the first of equals."""
    known = {_key(a) for names in aliases.values() for a in names}
    scores = [sum(_key(cell) in known for cell in row) for row in rows[:within]]
    best = max(range(len(scores)), key=lambda i: (scores[i], -i), default=-1)
    if best < 0 or scores[best] < least:
        raise ValueError("no row looks like a header")
    return best


def resolve_columns(header: Sequence[Any], aliases: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """Canonical name -> place, by exact alias; earlier aliases of a name win."""
    place: dict[str, int] = {}
    for i, cell in enumerate(header):
        place.setdefault(_key(cell), i)
    return {name: place[_key(a)] for name, options in aliases.items() for a in reversed(options) if _key(a) in place}


def sheet_frame(spark: SparkSession, rows: Sequence[Sequence[Any]], aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """A spreadsheet range with a header somewhere near its top, as text columns of canonical names; blank rows go."""
    top = header_row(rows, aliases)
    place = resolve_columns(rows[top], aliases)
    names = list(place)
    cells = [tuple(None if i >= len(r) or r[i] is None else str(r[i]).strip() for i in place.values()) for r in rows[top + 1 :]]
    found = [c for c in cells if any(c)]
    return spark.createDataFrame(found, ", ".join(f"`{n}` string" for n in names))


def excel_with_header(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], sheet: str | int = 0, within: int = 30) -> DataFrame:
    """A sheet with a header somewhere in its first rows, as text columns of canonical names; rows blank in all of them go."""
    top = xlsx.top_rows(spark, path, sheet, within)
    header = header_row(top, aliases, within)
    place = resolve_columns(top[header], aliases)
    below = xlsx.cells(spark, path, sheet, header + 2)
    values = below.select("row", *[F.nullif(F.trim(F.try_element_at("cells", F.lit(i))), F.lit("")).alias(n) for n, i in place.items()])
    return values.where(F.coalesce(*[F.col(f"`{n}`") for n in place]).isNotNull()).drop("row")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files; bytes that are not UTF-8 become U+FFFD."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


# --- events -----------------------------------------------------------------------------------------------------------


def event_stream_view(df: DataFrame, person: str, time: str, kind: str, optional: Mapping[str, str | None]) -> DataFrame:
    """One logical view of punches: a source with one row an event. Optional columns not configured are null."""
    return df.select(F.col(person).alias("person"), F.col(time).alias("event_time"), F.upper(F.col(kind)).alias("event_type"), *[(F.col(c) if c else F.lit(None).cast("string")).alias(k) for k, c in optional.items()])


def two_column_view(df: DataFrame, person: str, time_in: str, time_out: str, optional: Mapping[str, str | None]) -> DataFrame:
    """The same view of a source with an in and an out column in one row."""
    both = F.array(F.struct(F.col(time_in).alias("event_time"), F.lit("IN").alias("event_type")), F.struct(F.col(time_out).alias("event_time"), F.lit("OUT").alias("event_type")))
    rows = df.select(F.col(person).alias("person"), F.explode(both).alias("e"), *[(F.col(c) if c else F.lit(None).cast("string")).alias(k) for k, c in optional.items()])
    return rows.select("person", "e.event_time", "e.event_type", *optional).where("event_time is not null")


def field_value_record(df: DataFrame, array_col: str, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows that carry ``[{FieldName, Value}]`` as flat columns: the first non-blank of several field names."""
    named = F.map_from_entries(F.transform(array_col, lambda x: F.struct(x["FieldName"], x["Value"])))
    return df.withColumn("_m", named).withColumns({k: F.coalesce(*[blank_to_null(F.element_at("_m", n)) for n in names]) for k, names in fields.items()}).drop("_m")


# --- remote service ---------------------------------------------------------------------------------------------------


def odata_filter(filters: Sequence[Filter]) -> tuple[str, list[Filter]]:
    """The OData text of filters that such a service can evaluate, joined by ``and``, and those that it cannot."""

    def literal(v: Any) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else ("true" if v else "false") if isinstance(v, bool) else str(v)

    words = {EqualTo: "eq", GreaterThanOrEqual: "ge", LessThanOrEqual: "le"}
    parts, rest = [], []
    for f in filters:
        if isinstance(f, StringContains):
            parts.append(f"substringof({literal(f.value)}, {'/'.join(f.attribute)})")
        elif type(f) in words:
            parts.append(f"{'/'.join(f.attribute)} {words[type(f)]} {literal(f.value)}")
        else:
            rest.append(f)
    return " and ".join(parts), rest


class Pages(InputPartition):
    def __init__(self, first: int, count: int):
        super().__init__((first, count))


class PagedReader(DataSourceReader):
    """Reads a paged service: each partition fetches its own pages; filters are sent to the service."""

    def __init__(self, schema: StructType, options: Mapping[str, str], fetch: Callable[[str, int, int], Sequence[Mapping[str, Any]]]):
        self.schema, self.options, self.fetch, self.text = schema, options, fetch, ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.text, rest = odata_filter(filters)
        yield from rest

    def partitions(self) -> list[InputPartition]:
        pages, tasks = int(self.options.get("pages", "1")), max(1, int(self.options.get("tasks", "1")))
        size = -(-pages // tasks)
        return [Pages(i, min(size, pages - i)) for i in range(0, pages, size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, count = partition.value
        size = int(self.options.get("page_size", "500"))
        for page in range(first, first + count):
            for row in self.fetch(self.text, page, size):
                yield tuple(row.get(f.name) for f in self.schema)


def paged_source(name: str, ddl: str, fetch: Callable[[str, int, int], Sequence[Mapping[str, Any]]]) -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``; ``fetch(filter, page, size)`` returns rows as mappings.

    Filters are pushed down, so the session needs ``spark.sql.python.filterPushdown.enabled``.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ddl

        def reader(self, schema: StructType) -> DataSourceReader:
            return PagedReader(schema, self.options, fetch)

    return Paged
