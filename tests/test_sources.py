import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.helpers import minute_series, rows
from wattloom.operators.quality import interval_check
from wattloom.schema import READINGS
from wattloom.sources import catalog
from wattloom.sources import readings as io

FAILURE = (PySparkException, Py4JJavaError)


@pytest.fixture
def meter_folder(tmp_path):
    (tmp_path / "Home_reading7.csv").write_text("1301702400,5.25\n1301702460,1e-05\n")
    (tmp_path / "Home_reading012.csv").write_text('1301702400.0,"2"\n')
    (tmp_path / "notes.txt").write_text("not a meter\n")
    return tmp_path


def test_ingest_meter_files(spark, meter_folder):
    got = io.ingest_meter_files(spark, str(meter_folder))
    assert got.schema == READINGS
    assert rows(got) == [(12, 1301702400, 2.0), (7, 1301702400, 5.25), (7, 1301702460, 1e-05)]
    per_file = io.rows_per_file(spark, str(meter_folder)).collect()
    assert {r.file_path.rsplit("/", 1)[1]: r.n_rows for r in per_file} == {
        "Home_reading7.csv": 2,
        "Home_reading012.csv": 1,
    }


def test_file_without_meter_number_fails(spark, tmp_path):
    (tmp_path / "meter.csv").write_text("1,2.0\n")
    with pytest.raises(FAILURE):
        io.ingest_meter_files(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("line", ["1,2", "x,1301702400,1.0", "1,1301702400,abc", "1,2,3.0,4"])
def test_one_bad_row_fails_the_load(spark, tmp_path, line):
    (tmp_path / "all.csv").write_text(f"1,1301702400,1.0\n{line}\n")
    with pytest.raises(FAILURE):
        io.read_readings(spark, str(tmp_path / "all.csv")).collect()


def test_csv_round_trip(spark, make_readings, tmp_path):
    data = minute_series(1, 20, usage=lambda m: m / 3) + [(2, -5, None)]
    df = make_readings(data).repartition(3)
    io.write_readings_csv(df, str(tmp_path / "out"))
    assert rows(io.read_readings(spark, str(tmp_path / "out"))) == rows(df)
    parts = sorted((tmp_path / "out").glob("*.csv"))
    (tmp_path / "one.csv").write_text("".join(p.read_text() for p in parts))
    assert rows(io.read_readings(spark, str(tmp_path / "one.csv"))) == rows(df)


def test_sample(make_readings):
    data = minute_series(2, 5) + minute_series(1, 8) + [(1, 1301702400, -1.0)]
    got = [tuple(r) for r in io.sample_readings(make_readings(data)).collect()]
    assert got == sorted(data)[:10]


def test_tables(spark, make_readings, tmp_path):
    catalog.reset_namespace(spark, "wattloom_test")
    catalog.create_readings_table(spark, "wattloom_test.readings")
    assert spark.table("wattloom_test.readings").count() == 0
    io.write_readings_csv(make_readings(minute_series(1, 5)), str(tmp_path / "csv"))
    for _ in range(2):
        catalog.load_readings_csv(spark, str(tmp_path / "csv"), "wattloom_test.readings")
    loaded = spark.table("wattloom_test.readings")
    assert loaded.schema == READINGS and loaded.count() == 10
    by_meter = catalog.save_table(loaded, "wattloom_test.by_meter", ["building_num"], buckets=4)
    assert rows(by_meter) == rows(loaded)
    anywhere = catalog.save_table(loaded.limit(3), "wattloom_test.by_meter")
    assert anywhere.count() == 3
    catalog.reset_namespace(spark, "wattloom_test")
    assert not spark.catalog.tableExists("wattloom_test.readings")


@pytest.mark.parametrize("line", ["7,1301702400,oops", "bad,1301702400,1.0", "7,late,1.0"])
def test_a_bad_row_fails_whatever_is_asked_for(spark, tmp_path, line):
    (tmp_path / "readings.csv").write_text(f"6,1301702400,5.1\n{line}\n6,1301702460,5.2\n")
    readings = io.read_readings(spark, str(tmp_path))
    for ask in (readings, readings.select("building_num"), interval_check(readings), readings.where("usagekw > 1")):
        with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
            ask.collect()
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        readings.count()


def test_a_bad_row_fails_the_count_per_file(spark, tmp_path):
    (tmp_path / "Home_prefix_7.csv").write_text("1301702400,5.1\nbad,oops\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        io.rows_per_file(spark, str(tmp_path)).collect()


def test_a_hot_meter_is_written_by_several_tasks(spark):
    catalog.reset_namespace(spark, "wattloom_hot")
    rows = spark.range(20_000).selectExpr(
        "CAST(IF(id % 2 = 0, 1, id % 500) AS INT) AS building_num", "60 * id AS tslocal", "1e0 AS usagekw"
    )
    table = catalog.save_table(rows, "wattloom_hot.readings", ["building_num"], buckets=8, splits=4)
    sizes = [r[0] for r in table.where("building_num = 1").groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) >= 3 and max(sizes) < 10_000 * 0.5
    assert sorted(interval_check(table).collect()) == sorted(interval_check(rows).collect())
    with pytest.raises(ValueError):
        catalog.save_table(rows, "wattloom_hot.none", ["building_num"])
    catalog.reset_namespace(spark, "wattloom_hot")


def test_a_load_with_a_bad_line_leaves_the_table_as_it_was(spark, make_readings, tmp_path):
    catalog.reset_namespace(spark, "wattloom_load")
    catalog.create_readings_table(spark, "wattloom_load.readings")
    io.write_readings_csv(make_readings(minute_series(1, 5)), str(tmp_path / "good"))
    catalog.load_readings_csv(spark, str(tmp_path / "good"), "wattloom_load.readings")
    before = rows(spark.table("wattloom_load.readings"))
    (tmp_path / "half").mkdir()
    (tmp_path / "half" / "a.csv").write_text("".join(f"2,{n},1.0\n" for n in range(5000)) + "2,oops,1.0\n")
    (tmp_path / "half" / "b.csv").write_text("3,1,1.0\n\n  \n3,1\n3,1,2,3\n3,1\n")
    with pytest.raises(io.BadLines) as failure:
        catalog.load_readings_csv(spark, str(tmp_path / "half"), "wattloom_load.readings")
    assert failure.value.count == 4
    assert [(f.rsplit("/", 1)[1], line) for f, line in failure.value.first] == [
        ("a.csv", "2,oops,1.0"), ("b.csv", "3,1"), ("b.csv", "3,1,2,3"),
    ]
    assert rows(spark.table("wattloom_load.readings")) == before
    found = io.bad_lines(io.stage_readings(spark, str(tmp_path / "half")))
    assert {(x.line, x.copies) for x in found.collect()} == {("2,oops,1.0", 1), ("3,1", 2), ("3,1,2,3", 1)}
    catalog.load_readings_csv(spark, str(tmp_path / "good"), "wattloom_load.readings")
    assert spark.table("wattloom_load.readings").count() == 10
    catalog.reset_namespace(spark, "wattloom_load")


def test_nulls_and_quotes_are_readings(spark, tmp_path):
    (tmp_path / "all.csv").write_text('1,"1301702400",\n,,\n"2",5,"1e-3"\n')
    want = [(1, 1301702400, None), (2, 5, 0.001), (None, None, None)]
    assert rows(io.read_readings(spark, str(tmp_path))) == want
    assert rows(io.checked_readings(io.stage_readings(spark, str(tmp_path)))) == want


def test_lines_are_parsed_once_and_whole(spark, tmp_path):
    (tmp_path / "all.csv").write_text("1,1301702400,1.0\n")
    for ask in (
        io.read_readings(spark, str(tmp_path)).where("usagekw > 1"),
        io.read_readings(spark, str(tmp_path)).groupBy().count(),
    ):
        plan = ask._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_csv") == 1 and "Generate inline" in plan


def hot_rows(spark):
    return spark.range(40_000).selectExpr(
        "CAST(IF(id % 2 = 0, 1, id % 500) AS INT) AS building_num", "60 * (id div 3) AS tslocal", "id % 7e0 AS usagekw"
    )


def test_a_hot_meter_is_read_by_several_tasks_and_the_others_are_not_shuffled(spark):
    catalog.reset_namespace(spark, "wattloom_cut")
    readings = hot_rows(spark)
    table = catalog.save_distributed(readings, "wattloom_cut.by_meter", "building_num", buckets=8)
    assert [(x.building_num, x.n_rows, x.splits) for x in table.salts.collect()] == [(1, 20_080, 5)]
    assert rows(table.rows()) == rows(readings)
    again = catalog.read_distributed(spark, "wattloom_cut.by_meter")
    assert rows(again.rows()) == rows(readings) and rows(again.salts) == rows(table.salts)
    files = again.hot.groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 3 and max(x["count"] for x in files) < 20_080 / 2
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        assert again.hot.rdd.getNumPartitions() >= 3
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows(again.by_key(interval_check)) == rows(interval_check(readings))
    plan = interval_check(again.ordinary)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    catalog.reset_namespace(spark, "wattloom_cut")


def test_a_table_without_hot_keys_or_rows(spark):
    catalog.reset_namespace(spark, "wattloom_cut")
    even = spark.range(800).selectExpr("CAST(id % 100 AS INT) AS building_num", "60 * id AS tslocal", "1e0 AS usagekw")
    nulls = even.unionByName(spark.range(3).selectExpr("CAST(NULL AS INT) AS building_num", "id AS tslocal", "1e0 AS usagekw"))
    table = catalog.save_distributed(nulls, "wattloom_cut.even", "building_num", buckets=4)
    assert table.hot.count() == table.salts.count() == 0 and rows(table.rows()) == rows(nulls)
    empty = catalog.save_distributed(even.limit(0), "wattloom_cut.none", "building_num", buckets=4)
    assert empty.rows().count() == 0 and empty.by_key(interval_check).count() == 0
    catalog.reset_namespace(spark, "wattloom_cut")


def test_a_spread_table_is_the_same_again(spark):
    catalog.reset_namespace(spark, "wattloom_spread_test")
    data = hot_rows(spark)

    def files(df, name):
        table = catalog.save_spread(df, f"wattloom_spread_test.{name}", 5_000)
        assert rows(table) == rows(data)
        per_file = {}
        for x in table.withColumn("f", F.input_file_name()).collect():
            per_file.setdefault(x.f, []).append(tuple(x)[:3])
        return sorted(sorted(x) for x in per_file.values())

    one, two = files(data, "one"), files(data.repartition(13, "tslocal"), "two")
    assert one == two and len(one) == 8 and max(map(len, one)) < 6_000
    catalog.reset_namespace(spark, "wattloom_spread_test")


@pytest.mark.parametrize("rows_per_part", [1000, 10_000_000])
def test_one_csv_in_order(spark, make_readings, tmp_path, rows_per_part):
    data = [(m, 60 * (n * 37 % 400), float(n)) for m in (3, 1, 2, 10) for n in range(1000)] + [(None, None, None), (1, None, 2.5)]
    path = tmp_path / "folder" / "all.csv"
    for _ in range(2):  # an older file is replaced
        parts = io.write_single_csv(make_readings(data).repartition(7), f"file://{path}", rows_per_part)
    assert parts == (1 if rows_per_part > 4002 else 5)
    lines = [x.split(",") for x in path.read_text().splitlines()]
    got = [tuple(kind(x) if x else None for kind, x in zip((int, int, float), line)) for line in lines]
    assert got == sorted(data, key=lambda r: tuple((x is not None, x or 0) for x in r))
    assert rows(io.read_readings(spark, str(path))) == rows(make_readings(data))
    assert [x.name for x in path.parent.iterdir() if not x.name.startswith(".")] == ["all.csv"]


def test_one_csv_of_nothing(spark, make_readings, tmp_path):
    assert io.write_single_csv(make_readings([]), f"file://{tmp_path}/none.csv") == 0
    assert (tmp_path / "none.csv").read_text() == ""
