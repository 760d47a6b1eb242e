import datetime

import pytest

from mapquarry.operators import history

T = 1_500_000_000


@pytest.fixture(scope="module")
def versions(spark):
    rows = [
        (1, 1, T, True, {"a": "1", "b": "2"}),
        (1, 2, T + 10, True, {"a": "3"}),
        (2, 1, T, True, {"x": "y"}),
        (2, 2, T + 5, False, {}),
        (3, 1, T + 50, True, {}),
    ]
    return spark.createDataFrame(rows, "id long, version int, timestamp long, visible boolean, tags map<string,string>")


def state(df):
    return {r.id: (r.version, r.tags) for r in df.collect()}


def test_last_values(versions):
    assert state(history.as_of(versions, T + 20, fold_tags=True)) == {1: (2, {"a": "3", "b": "2"}), 2: (1, {"x": "y"})}
    assert state(history.as_of(versions, T + 20)) == {1: (2, {"a": "3"}), 2: (1, {"x": "y"})}


def test_strict(versions):
    assert state(history.as_of(versions, T + 20, strict=True)) == {1: (2, {"a": "3"})}
    assert state(history.as_of(versions, T + 60, strict=True))[3] == (1, {})


def test_moments():
    assert history.moment("2020-01-02") == 1_577_923_200
    assert history.moment(datetime.date(2020, 1, 2)) == 1_577_923_200
    with pytest.warns(UserWarning):
        history.moment(None)
    for bad in ("2004-01-01", "2999-01-01", 1.5, True):
        with pytest.raises(ValueError):
            history.moment(bad)
    assert history.is_history("X.OSH.PBF") and not history.is_history("x.osm.pbf")
