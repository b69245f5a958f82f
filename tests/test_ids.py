import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.helpers import minute_series
from wattloom.operators import ids


def test_ids_equal_global_numbering(make_readings):
    meters = [-70_000, -1, 0, 3, 65_535, 65_536, 200_000, 2_000_000_000]
    data = [r for m in meters for r in minute_series(m, 5)]
    random.Random(3).shuffle(data)
    df = make_readings(data)
    expected = df.select(
        F.row_number().over(Window.orderBy("building_num", "tslocal")).alias("rgid"),
        F.dense_rank().over(Window.orderBy("building_num")).alias("bgid"),
        F.row_number().over(Window.partitionBy("building_num").orderBy("tslocal")).alias("rid"),
        "building_num",
        "tslocal",
        "usagekw",
    )
    assert sorted(map(tuple, ids.assign_ids(df).collect())) == sorted(map(tuple, expected.collect()))


def test_numbering_of_meters(spark):
    meters = [(m, m % 5) for m in random.Random(1).sample(range(-(2**31), 2**31), 3000)]
    df = spark.createDataFrame(meters, "building_num int, n_rows long")
    got = ids.number_meters(df).orderBy("building_num").collect()
    before = 0
    for position, row in enumerate(got, start=1):
        assert (row.bgid, row.rows_before) == (position, before)
        before += row.n_rows


def test_large_inputs_need_no_broadcast(make_readings, no_broadcast):
    data = minute_series(5, 10) + minute_series(9, 10)
    got = ids.assign_ids(make_readings(data)).collect()
    assert sorted(r.rgid for r in got) == list(range(1, 21))
    assert all(r.rgid == (r.bgid - 1) * 10 + r.rid for r in got)
