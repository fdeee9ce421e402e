"""Catalog requests: their grammar, pages that are followed to the end, and values that are only compared."""

from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from tessera.operators import requests
from tessera.operators.requests import Request, answered, app_rows, followed, parsed

GOOD = {
    "": Request(),
    "/data/records?limit=500&include=metadata,labels": Request(500, include=frozenset(("metadata", "labels"))),
    "?limit=1": Request(1),
    "cursor=": Request(),
    "cursor=a%26b%3Dc+d": Request(cursor="a&b=c d"),
    "updated_after=2024-01-02T00%3A00%3A00Z": Request(updated_after="2024-01-02T00:00:00Z"),
    "label=photos%2Fcrop": Request(label=("photos", "crop")),
    "label=a/b/c&labelValue=": Request(label=("a", "b/c"), label_value=""),
    "label=a/b&labelValue=%27%20or%201%3D1%20--": Request(label=("a", "b"), label_value="' or 1=1 --"),
}
BAD = ["limit=0", "limit=1001", "limit=-1", "limit=1e2", "limit=", "limit=٣", "limit=5&limit=6", "include=all", "include=", "include=labels,labels,faces", "label=crop", "label=/crop", "label=app/", "labelValue=1", "order=id", "Limit=5", "id=1;drop", "limit", "a=1&b=2&c=3&d=4&e=5&f=6&g=7"]


@pytest.mark.parametrize("text", GOOD)
def test_what_is_known(text):
    assert parsed(text) == GOOD[text]


@pytest.mark.parametrize("text", BAD)
def test_what_is_refused(text):
    with pytest.raises(ValueError):
        parsed(text)


@pytest.fixture(scope="module")
def catalog(spark):
    ids = [f"r{k:02d}" for k in range(23)] + ["r' or '1'='1", "z`x"]
    records = spark.createDataFrame([(i, f"2024-01-{k + 1:02d}", "image/png" if k % 2 else "video/mp4") for k, i in enumerate(ids)], "id string, updated_at string, type string")
    labels = spark.createDataFrame([(i, "app", "crop", str(k % 3)) for k, i in enumerate(ids) if k % 4 == 0] + [(ids[0], "app", "crop", "9"), ("gone", "app", "crop", "0")], "record_id string, app_id string, key string, value string")
    metadata = spark.createDataFrame([(i, k) for k, i in enumerate(ids) if k % 5], "record_id string, width int")
    return ids, records, labels, metadata


def pages(text, catalog, **more):
    _, records, labels, metadata = catalog
    seen = []

    def fetch(cursor):
        rows = answered(f"{text}&cursor={quote(cursor or '')}", records, labels, metadata, **more).collect()
        seen.append(len(rows))
        return [r.id for r in rows], rows[0].next_cursor if rows else None

    return list(followed(fetch)), seen


def test_pages_follow_one_another(catalog):
    ids = catalog[0]
    for size in (1, 4, 5, 24, 25, 26):
        got, seen = pages(f"limit={size}", catalog)
        assert got == sorted(ids) and all(n == size for n in seen[:-1]) and len(seen) == -(-25 // size)


def test_labels_hold_below_the_limit(catalog):
    ids = catalog[0]
    got, seen = pages("limit=2&label=app/crop", catalog)
    assert got == sorted(i for k, i in enumerate(ids) if k % 4 == 0) and seen == [2, 2, 2, 1]
    assert pages("limit=500&label=app/crop&labelValue=9", catalog)[0] == [ids[0]]
    assert pages("limit=500&label=app/other", catalog)[0] == []
    assert pages("limit=500&label=app/crop&labelValue=%27 or 1 -- ", catalog)[0] == []


def test_types_and_changes_hold_together(catalog):
    ids, records, labels, metadata = catalog
    got = answered("updated_after=2024-01-05&limit=3&label=app/crop", records, labels, metadata, ["video/mp4"]).collect()
    assert [r.id for r in got] == sorted(i for k, i in enumerate(ids) if k > 4 and k % 4 == 0 and k % 2 == 0)[:3]


def test_parts_are_null_unless_asked_for(catalog):
    ids, records, labels, metadata = catalog
    bare = answered("limit=2", records, labels, metadata).collect()
    whole = answered("limit=500&include=labels,metadata", records, labels, metadata).collect()
    assert [(r.metadata, r.labels) for r in bare] == [(None, None)] * 2
    by = {r.id: r for r in whole}
    assert by[ids[0]].metadata is None and by[ids[1]].metadata.width == 1 and by[ids[1]].labels == []
    assert [(x.app_id, x.key, x.value) for x in by[ids[0]].labels] == [("app", "crop", "0"), ("app", "crop", "9")]


def test_short_pages_are_not_the_end():
    answers = {None: (["a"], "c1"), "c1": ([], "c2"), "c2": (["b", "c"], "c3"), "c3": (["d"], None)}
    asked = []
    assert list(followed(lambda c: (asked.append(c), answers[c])[1])) == ["a", "b", "c", "d"] and asked == [None, "c1", "c2", "c3"]
    assert list(followed(lambda c: ([], None))) == []
    with pytest.raises(ValueError, match="advance"):
        list(followed(lambda c: (["x"], "same")))


def test_predicates_reach_the_scan(spark, catalog, tmp_path):
    _, records, labels, metadata = catalog
    records.write.parquet(f"{tmp_path}/records")
    df = answered("limit=2&updated_after=2024-01-05&cursor=r03", spark.read.parquet(f"{tmp_path}/records"), labels, metadata)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,r03)" in plan and "GreaterThan(updated_at,2024-01-05)" in plan and "TakeOrdered" in plan


def test_app_tables_take_equality_alone(spark):
    table = spark.createDataFrame([("r1", "a"), ("r2", "b"), ("r2", "a")], "record_id string, caption string")
    assert app_rows("record_id=r2&caption=a", table).collect() == table.where("record_id = 'r2' and caption = 'a'").collect()
    assert app_rows("", table).count() == 3
    with pytest.raises(ValueError):
        app_rows("limit=3", table)


def test_an_empty_catalog(catalog):
    _, records, labels, metadata = catalog
    assert answered("limit=3&include=labels,metadata", records.limit(0), labels, metadata).count() == 0
    assert requests.rendered_labels(F.lit(None).cast("array<struct<app_id:string,key:string,value:string>>")) is not None
