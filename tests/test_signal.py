import pytest
from pyspark.sql import functions as F

from crosscheck import fixtures
from tests.helpers import minute_series
from wattloom.operators import features, ids, quality, signal
from wattloom.plans.profile import meter_series
from wattloom.schema import ProfileConfig


def steps(readings, config):
    clean = quality.complete_readings(readings, expected_readings=config.expected_readings)
    nozero = signal.drop_all_zero(ids.assign_ids(clean))
    windows = signal.window_sum(nozero, config.window_seconds)
    return signal.series_arrays(signal.normalize_signal(windows), config.min_denominator)


def by_meter(df):
    return {r.building_num: r.asDict() for r in df.collect()}


def test_zero_filter_and_offset(make_readings):
    data = minute_series(1, 4, usage=lambda m: 0.0)
    data += minute_series(2, 4, usage=lambda m: [-1.0, 0.0, 1.0, 0.0][m])
    data += minute_series(3, 4, usage=lambda m: None)
    data += minute_series(4, 4, usage=lambda m: [None, 0.0, 2.0, None][m])
    out = signal.drop_all_zero(ids.assign_ids(make_readings(data)))
    kept = sorted((r.bgid, r.tslocal_fromzero) for r in out.collect())
    assert kept == [(b, 60 * m) for b in (2, 4) for m in range(4)]


def test_windows_start_with_the_first_reading(make_readings):
    data = minute_series(1, 12, start=1301702400 + 77, usage=float)
    data[3] = (1, data[3][1], None)
    nozero = signal.drop_all_zero(ids.assign_ids(make_readings(data)))
    out = signal.window_sum(nozero, with_arrays=True).orderBy("win_id").collect()
    assert [r.win_id for r in out] == [0, 1, 2]
    assert [r.usagekw_sum_5min for r in out] == [0 + 1 + 2 + 4, 5 + 6 + 7 + 8 + 9, 10 + 11]
    assert out[0].usagekw_arr == [0.0, 1.0, 2.0, None, 4.0]  # missing values keep their place
    assert out[1].rid_arr == [6, 7, 8, 9, 10]
    assert out[2].tslocal_fromzero_arr == [600, 660]


def test_normalisation_divides_by_the_sum_of_squares(make_readings):
    data = minute_series(1, 10, usage=lambda m: float(m >= 5)) + minute_series(2, 10, usage=lambda m: 3.0)
    windows = signal.window_sum(signal.drop_all_zero(ids.assign_ids(make_readings(data))))
    out = signal.normalize_signal(windows).orderBy("bgid", "win_id").collect()
    assert [r.usagekw_sum_5min_norm for r in out] == [-0.2, 0.2, None, None]
    assert [r.usagekw_sum_5min_norm_denom for r in out] == [12.5, 12.5, 0.0, 0.0]
    series = signal.series_arrays(signal.normalize_signal(windows)).collect()
    assert [r.bgid for r in series] == [1]
    assert series[0].win_id_arr == [0, 1] and series[0].usagekw_sum_5min_arr == [0.0, 5.0]


@pytest.mark.parametrize("common_span", [False, True])
def test_direct_route_equals_the_steps(spark, sf, common_span):
    readings = fixtures.readings(spark, sf)
    config = ProfileConfig(require_common_span=common_span)
    assert_same_series(by_meter(meter_series(readings, config)), by_meter(steps(readings, config)))


def assert_same_series(direct, stepwise):
    assert direct.keys() == stepwise.keys() and direct
    for meter, row in direct.items():
        for name, value in row.items():
            assert value == pytest.approx(stepwise[meter][name], rel=1e-9, abs=1e-12), (meter, name)


def test_direct_route_without_broadcast(make_readings, no_broadcast):
    data = [
        r for m in (3, 5, 9, 70_001)
        for r in minute_series(m, 40, start=m * 100, usage=lambda t, m=m: float(t * m % 11))
    ]
    data += minute_series(4, 39) + [(8, 0, 1.0)] * 500 + minute_series(6, 40, usage=lambda t: 0.0)
    df = make_readings(data)
    config = ProfileConfig(expected_readings=40)
    direct, stepwise = by_meter(meter_series(df, config)), by_meter(steps(df, config))
    assert sorted(direct) == [3, 5, 9, 70_001]
    assert direct[70_001]["bgid"] == 5  # the dead meter 6 keeps its number
    assert_same_series(direct, stepwise)


def test_sums_of_normalised_signals_vanish(spark, sf):
    series = meter_series(fixtures.readings(spark, sf))
    total = F.aggregate("usagekw_sum_5min_norm_arr", F.lit(0.0), lambda s, v: s + v)
    assert series.select(F.max(F.abs(total))).collect()[0][0] < 1e-12


def test_spectral_power_equals_signal_power(spark, sf):
    """Parseval: all bins, mirrored ones included, hold the signal's sum of squares."""
    spectra = features.periodogram(meter_series(fixtures.readings(spark, sf))).collect()
    assert len(spectra) == 70
    for row in spectra:
        x, p = row.usagekw_sum_5min_norm_arr, row.pgram_norm_arr
        assert len(p) == 144 and row.pgram_pt_id_arr == list(range(144))
        assert 2 * sum(p[:-1]) + p[-1] + sum(x) ** 2 / 288 == pytest.approx(sum(v * v for v in x))
