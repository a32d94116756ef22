"""What findings about larger tables led to: work is done once, by few rows, and by all cores."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orderweave.functions import geometry as G
from orderweave.operators import course as C
from orderweave.operators import interim
from orderweave.operators import service as S
from orderweave.plans import orders, services
from orderweave.sources.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small(spark):
    return Tables(spark, SF)


def square(x: float, y: float = 0.0, a: float = 10.0) -> list[float]:
    return [x, y, x + a, y, x + a, y + a, x, y + a]


def test_a_box_is_looked_at_once_however_many_it_is_held_against(monkeypatch):
    seen, whole = [], G._circle
    monkeypatch.setattr(G, "_circle", lambda q: seen.append(q) or whole(q))
    out = G.quad_overlaps([square(0), square(5)], [square(0), square(4), square(100)])
    assert len(seen) == 5
    assert out.round(6).tolist() == [[1.0, round(60 / 140, 6), 0.0], [round(50 / 150, 6), round(90 / 110, 6), 0.0]]
    assert G.quad_overlaps([square(0)], [[None] * 8, square(0)]).round(6).tolist() == [[0.0, 1.0]]


def test_arrow_columns_unpack_as_to_pylist(spark):
    import pyarrow as pa

    lists = pa.array([["a", None], None, [], ["b"]], pa.list_(pa.string()))
    for column in (lists, lists[1:], pa.array([1, 2]), pa.array([1, None]), pa.array([0.5, None]), pa.array(["x", None]), pa.array([[1.5, None], [2.5]]), pa.array([True, None])):
        assert interim.values(column) == column.to_pylist()


def test_walks_are_dealt_to_many_tasks_though_their_rows_are_few_bytes(small):
    rows = S.events(services.feed(small), services.SERVICE)
    assert rows.rdd.getNumPartitions() == interim.tasks(small.spark) >= 4 * small.spark.sparkContext.defaultParallelism


def test_only_lines_of_the_tickets_shown_are_worked_on(small):
    some = small.lineitem.select(F.col("l_orderkey").alias("ticket")).distinct().where("ticket % 5 = 0")
    for view in ("ticket_lines", "ticket_boxes"):
        got, want = getattr(small.only(some), view), getattr(small, view).where("ticket % 5 = 0")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_walks_of_orders_are_dealt_to_many_tasks(small):
    assert C.order_events(small.observations).rdd.getNumPartitions() == interim.tasks(small.spark)


def test_bags_are_filled_without_an_object_for_each_entry(spark):
    bags = C._Bags()
    for bag in ({"a": 2, "b": 1}, None, {}, {"c": 3}):
        bags.add(bag)
    assert bags.array().to_pylist() == [[{"item": "a", "n": 2}, {"item": "b", "n": 1}], None, [], [{"item": "c", "n": 3}]]


def test_menu_items_are_dealt_once_to_tasks_that_arent_joined(small):
    assert orders.menu_expand(small).rdd.getNumPartitions() == interim.tasks(small.spark)
