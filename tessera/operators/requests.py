"""Catalog requests: a query string becomes one plan over records, labels and metadata.

The parameters are ``limit`` (1 to 1000, by default 500), ``cursor`` (exclusive, by id), ``include`` (metadata, labels),
``updated_after`` (exclusive), ``label`` (app/key) and ``labelValue``; they hold together. Values are only ever compared as
literals. Predicates, label ones as semi joins, stand below the limit; what is included is joined to the page alone, which is
at most ``MOST`` rows and so may be broadcast. A page knows the cursor of the next one, null at the end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.catalog import having_label

DEFAULT, MOST = 500, 1000
PARAMETERS = ("limit", "cursor", "include", "updated_after", "label", "labelValue")
PARTS = ("metadata", "labels")


@dataclass(frozen=True)
class Request:
    """What a query string asks for."""

    limit: int = DEFAULT
    cursor: str | None = None
    include: frozenset[str] = field(default_factory=frozenset)
    updated_after: str | None = None
    label: tuple[str, str] | None = None
    label_value: str | None = None


def pairs(text: str, known: tuple[str, ...]) -> dict[str, str]:
    """The parameters of a query string (a path before it is ignored), each at most once."""
    query = text.split("?", 1)[1] if "?" in text else text
    found: dict[str, str] = {}
    for name, value in parse_qsl(query, keep_blank_values=True, strict_parsing=bool(query), max_num_fields=len(known)):
        if name not in known:
            raise ValueError(f"unknown parameter {name!r}")
        if name in found:
            raise ValueError(f"{name} is given twice")
        found[name] = value
    return found


def parsed(text: str) -> Request:
    """The request of a query string; ValueError if there is anything it doesn't know. Blank cursors count as none."""
    given = pairs(text, PARAMETERS)
    limit = given.get("limit", str(DEFAULT))
    if not re.fullmatch(r"[0-9]{1,4}", limit) or not 1 <= int(limit) <= MOST:
        raise ValueError(f"limit has to be 1 to {MOST}")
    include = frozenset(given["include"].split(",")) if "include" in given else frozenset()
    if not include <= set(PARTS):
        raise ValueError(f"include knows {', '.join(PARTS)}")
    app, slash, key = given.get("label", "").partition("/")
    if "label" in given and not (app and slash and key):
        raise ValueError("label has to be app/key")
    if "labelValue" in given and "label" not in given:
        raise ValueError("labelValue needs a label")
    return Request(int(limit), given.get("cursor") or None, include, given.get("updated_after") or None, (app, key) if "label" in given else None, given.get("labelValue"))


def matching(request: Request, records: DataFrame, labels: DataFrame, updated: str) -> DataFrame:
    """All records that a request's predicates hold for, whatever its limit."""
    found = records
    if request.cursor is not None:
        found = found.where(F.col("id") > F.lit(request.cursor))
    if request.updated_after is not None:
        found = found.where(F.col(updated) > F.lit(request.updated_after))
    if request.label is not None:
        found = having_label(found, labels, *request.label, request.label_value)
    return found


def answered(request: Request | str, records: DataFrame, labels: DataFrame, metadata: DataFrame, granted: list[str] | None = None, updated: str = "updated_at") -> DataFrame:
    """The page: records in the order of id, with ``next_cursor``, ``metadata`` (a struct, null without a row) and ``labels``, these null unless included.

    granted: types that may be seen; others don't count.
    """
    request = parsed(request) if isinstance(request, str) else request
    seen = records if granted is None else records.where(F.col("type").isin(granted))
    some = matching(request, seen, labels, updated).orderBy("id").limit(request.limit + 1)
    # limit + 1 rows at most: their order may be one task's
    numbered = some.withColumn("_n", F.row_number().over(Window.orderBy("id")))
    whole = Window.partitionBy()
    at_end = F.when(F.max("_n").over(whole) > request.limit, F.max(F.when(F.col("_n") == request.limit, F.col("id"))).over(whole))
    page = numbered.withColumn("next_cursor", at_end).where(F.col("_n") <= request.limit).select(*records.columns, "next_cursor")
    return with_labels(with_metadata(page, metadata, "metadata" in request.include), labels, "labels" in request.include)


def with_metadata(page: DataFrame, metadata: DataFrame, wanted: bool) -> DataFrame:
    row = F.struct(*[c for c in metadata.columns if c != "record_id"])
    if not wanted:
        return page.withColumn("metadata", F.lit(None).cast(metadata.select(row.alias("m")).schema["m"].dataType))
    own = metadata.join(F.broadcast(page.select(F.col("id").alias("record_id"))), "record_id", "left_semi").select(F.col("record_id").alias("_m"), row.alias("metadata"))
    return page.join(own, F.col("id") == F.col("_m"), "left").drop("_m")


def with_labels(page: DataFrame, labels: DataFrame, wanted: bool) -> DataFrame:
    kind = "array<struct<app_id:string,key:string,value:string>>"
    if not wanted:
        return page.withColumn("labels", F.lit(None).cast(kind))
    own = labels.join(F.broadcast(page.select(F.col("id").alias("record_id"))), "record_id", "left_semi")
    own = own.groupBy(F.col("record_id").alias("_l")).agg(F.array_sort(F.collect_list(F.struct("app_id", "key", "value"))).alias("labels"))
    return page.join(own, F.col("id") == F.col("_l"), "left").withColumn("labels", F.coalesce("labels", F.array().cast(kind))).drop("_l")


def app_rows(text: str, table: DataFrame) -> DataFrame:
    """Rows of an app's own table where each column of the query string has the given text; other predicates aren't known."""
    found = table
    for name, value in pairs(text, tuple(table.columns)).items():
        found = found.where(F.col(f"`{name}`").cast("string") == F.lit(value))
    return found


def followed(fetch: Callable[[str | None], tuple[list, str | None]]) -> Iterator:
    """All rows of all pages. ``fetch`` gives the rows after a cursor and the next cursor.

    A short page isn't the end, the lack of a cursor is; a cursor that stands still would never end, so it raises.
    """
    cursor = None
    while True:
        rows, after = fetch(cursor)
        yield from rows
        if not after:
            return
        if cursor is not None and after <= cursor:
            raise ValueError(f"the cursor doesn't advance: {after!r}")
        cursor = after


def rendered_labels(labels: Column) -> Column:
    """app/key=value, joined by commas; null where labels aren't included."""
    return F.array_join(F.transform(labels, lambda x: F.concat(x["app_id"], F.lit("/"), x["key"], F.lit("="), x["value"])), ",")
