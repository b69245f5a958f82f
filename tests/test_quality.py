import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import gap_counts, minute_series, random_readings, raster_readings, rows
from wattloom.operators import quality


def check(df, interval=60):
    return {r[0]: tuple(r[1:]) for r in quality.interval_check(df, interval).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_interval_check_equals_definition(make_readings, seed):
    data = random_readings(seed)
    assert check(make_readings(data)) == gap_counts(data)


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_check_on_a_raster(make_readings, seed):
    data = raster_readings(seed)
    assert check(make_readings(data)) == gap_counts(data)


@pytest.mark.parametrize("interval", [1, 900])
def test_other_intervals(make_readings, interval):
    data = minute_series(1, 3000, step=interval) + minute_series(2, 5, step=interval + 1)
    assert check(make_readings(data), interval) == gap_counts(data, interval)


def test_edges_of_the_gap_check(make_readings):
    data = [(1, 5, 1.0)]  # a lone reading passes
    data += [(2, 0, 1.0), (2, 60, 1.0), (2, 60, 2.0)]  # a repeated instant does not
    data += [(3, 86_340, 1.0), (3, 86_400, 1.0)]  # a gap across slots
    data += [(4, -60, 1.0), (4, 0, 1.0)]  # around zero
    data += [(5, None, 1.0)]  # no time at all
    data += [(6, 0, None), (6, 60, None)]  # usage does not matter
    assert check(make_readings(data)) == {
        1: (1, 0, 1),
        2: (3, 1, 2),
        3: (2, 1, 1),
        4: (2, 1, 1),
        5: (0, 0, 0),
        6: (2, 1, 1),
    }


def test_empty_input(make_readings):
    empty = make_readings([])
    assert check(empty) == {}
    assert quality.complete_readings(empty).count() == 0
    assert quality.regular_readings(empty).count() == 0
    assert quality.count_regular_meters(empty).collect()[0][0] == 0


def expected_regular(data):
    good = {m for m, (_, _, d) in gap_counts(data).items() if d == 1 and m is not None}
    return sorted((r for r in data if r[0] in good), key=repr)


@pytest.mark.parametrize("heaviest", [1, 2, 2000])
def test_regular_readings_with_heavy_meters(make_readings, heaviest):
    """Heavy accepted, heavy rejected and ordinary meters, whichever way they are matched."""
    data = minute_series(1, 4000) + minute_series(2, 30) + minute_series(7, 1)
    data += [(3, 0, 1.0)] * 5000  # copies hold more than half of all rows
    data += [(4, 0, 1.0), (4, 61, 1.0), (None, 0, 1.0), (None, 60, 1.0)]
    got = quality.regular_readings(make_readings(data), heaviest=heaviest)
    assert rows(got) == expected_regular(data)


def test_regular_readings_without_broadcast(make_readings, no_broadcast):
    data = minute_series(1, 3000) + minute_series(2, 30) + [(3, 0, 1.0)] * 40
    assert rows(quality.regular_readings(make_readings(data), heaviest=1)) == expected_regular(data)


def test_regular_rows_with_missing_time_are_kept(make_readings):
    data = minute_series(1, 3) + [(1, None, 9.0)]
    assert quality.regular_readings(make_readings(data)).count() == 4


def test_complete_readings(make_readings):
    data = minute_series(1, 1440) + minute_series(2, 1439) + minute_series(3, 1440, start=60)
    data += [(4, 0, 1.0)] * 1440
    df = make_readings(data)
    kept = quality.complete_readings(df).groupBy("building_num").count().collect()
    assert {r[0]: r[1] for r in kept} == {1: 1440, 3: 1440}
    assert rows(quality.completeness_histogram(quality.complete_readings(df))) == [(1440, 2)]


def test_common_span_is_optional(make_readings):
    data = minute_series(1, 10) + minute_series(2, 10) + minute_series(3, 10, start=0)
    df = make_readings(data)
    meters = lambda **o: sorted(
        r[0]
        for r in quality.complete_readings(df, expected_readings=10, **o)
        .select("building_num")
        .distinct()
        .collect()
    )
    assert meters() == [1, 2, 3]
    assert meters(require_common_span=True) == [1, 2]


def test_spans_and_counts(make_readings):
    data = minute_series(1, 5) + minute_series(2, 5) + minute_series(3, 3) + [(4, 0, 1.0), (4, 1, 1.0)]
    df = make_readings(data)
    spans = quality.meter_spans(df)
    start = 1301702400
    assert rows(spans) == [
        (1, start, start + 240, 5),
        (2, start, start + 240, 5),
        (3, start, start + 120, 3),
    ]
    assert [tuple(r) for r in quality.span_histogram(spans).collect()] == [
        (start, start + 120, 3, 1),
        (start, start + 240, 5, 2),
    ]
    assert quality.count_regular_meters(df).collect()[0][0] == 3


def test_summary_is_independent_of_partitioning(make_readings):
    data = random_readings(5)
    df = make_readings(data)
    one = rows(quality.meter_summary(df.coalesce(1), usage_range=True))
    many = rows(quality.meter_summary(df.repartition(13, F.rand(1)), usage_range=True))
    assert one == many


def test_a_state_of_several_loads_is_that_of_one(spark, make_readings, tmp_path):
    """Repeats within a load and over loads, late readings, new meters, instants at the edges of slots."""
    from wattloom.sources import gap_state

    folder, rng = f"file://{tmp_path}/state", random.Random(11)
    data = raster_readings(5, 400) + random_readings(6) + [(None, 60, 1.0), (7, None, 1.0), (8, 86_340, 1.0), (8, 86_400, 1.0)]
    data += rng.choices(data, k=200)
    rng.shuffle(data)
    done = []
    for n, cut in enumerate((slice(0, 1500), slice(1500, 1600), slice(1600, None))):
        part = data[cut]
        assert gap_state.load_gaps(make_readings(part), folder) == n + 1
        done += part
        assert rows(gap_state.gap_summary(spark, folder)) == rows(quality.meter_summary(make_readings(done)))
    assert gap_state.load_gaps(make_readings([]), folder) == 4
    assert rows(gap_state.gap_summary(spark, folder)) == rows(quality.meter_summary(make_readings(data)))


def test_a_load_reads_and_writes_the_touched_slots_only(spark, make_readings, tmp_path):
    from wattloom.sources import gap_state

    folder, day = tmp_path / "state", 86_400
    for n in range(4):
        gap_state.load_gaps(make_readings(minute_series(1, 1440, start=n * day)), f"file://{folder}")
    gap_state.load_gaps(make_readings([(1, 2 * day + 60, 0.5), (2, 2 * day, 1.0)]), f"file://{folder}")
    written = sorted(x.name for x in (folder / "masks" / "load=5").glob("slot=*"))
    assert written == [f"slot={2 * day}"]
    files = gap_state.gap_masks(spark, f"file://{folder}").inputFiles()
    assert sorted({tuple(f.split("/")[-3:-1]) for f in files}) == [
        ("load=1", "slot=0"), ("load=2", f"slot={day}"), ("load=4", f"slot={3 * day}"), ("load=5", f"slot={2 * day}"),
    ]
    assert {x.building_num: x.diff_ct for x in gap_state.gap_summary(spark, f"file://{folder}").collect()} == {1: 2, 2: 1}


def test_a_load_without_a_manifest_does_not_count(spark, make_readings, tmp_path):
    import shutil

    from wattloom.sources import gap_state

    folder = f"file://{tmp_path}/state"
    assert gap_state.gap_summary(spark, folder).count() == 0
    gap_state.load_gaps(make_readings(minute_series(1, 10)), folder)
    before = rows(gap_state.gap_summary(spark, folder))
    gap_state.load_gaps(make_readings(minute_series(1, 20)), folder)
    (tmp_path / "state" / "manifest" / "00000002" / "_SUCCESS").unlink()  # as if the second load had failed
    assert rows(gap_state.gap_summary(spark, folder)) == before
    assert gap_state.load_gaps(make_readings(minute_series(1, 20, start=1301702400 + 600)), folder) == 2
    assert [(x.ct_tslocal, x.diff_ct) for x in gap_state.gap_summary(spark, folder).collect()] == [(30, 1)]
