"""Hourly volumes: the same hours whatever the number of runs, repeated events counted once, silent hours judged."""

import pandas as pd
import pytest

from tests.conftest import SF_SMALL
from wardwise.streaming.jobs import hourly_volume


@pytest.fixture(scope="module")
def events():
    """All events, one site silent for the last three days and another for two days in between."""
    events = pd.read_parquet(f"{SF_SMALL}/events.parquet").sort_values("ts", kind="stable").reset_index(drop=True)
    first, second = sorted(events["event_type"].unique())[:2]
    end = events["ts"].max()
    gone = (events["event_type"] == first) & (events["ts"] > end - pd.Timedelta(days=3))
    gone |= (events["event_type"] == second) & events["ts"].between(end - pd.Timedelta(days=9), end - pd.Timedelta(days=7))
    return events[~gone].reset_index(drop=True)


def expected(events):
    once = events.drop_duplicates("event_id")
    hours = once.assign(hour=once["ts"].dt.floor("h")).groupby(["event_type", "hour"]).size()
    end, out = once["ts"].max() - pd.Timedelta(hours=1), []
    for site, per_hour in hours.groupby(level=0):
        before, per_hour = [], per_hour.droplevel(0)
        for hour in pd.date_range(per_hour.index.min(), end.floor("h") - pd.Timedelta(hours=1), freq="h"):
            n = int(per_hour.get(hour, 0))
            threshold = int(1.25 * sum(before) / len(before)) if before else None
            out.append((site, hour.to_pydatetime(), n, len(before), threshold, int(threshold is not None and n > threshold)))
            before.append(n)
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def put(folder, k, part):
    folder.mkdir(parents=True, exist_ok=True)
    part.to_parquet(folder / f"part-{k}.parquet", index=False, coerce_timestamps="us")


def test_hourly_volume_over_restarts(spark, events, tmp_path):
    """Three runs over a growing folder, with events sent twice, equal one run over all of them."""
    cuts = [0, len(events) // 3, len(events) // 2, len(events)]
    parts = [events.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    out = str(tmp_path / "out")
    for k, part in enumerate(parts):
        again = part.tail(40)  # sent once more within the watermark
        put(tmp_path / "grows" / "events.parquet", k, pd.concat([part, again]))
        rows = collected(hourly_volume(spark, str(tmp_path / "grows"), out))
    assert rows == expected(events) and len({r[0] for r in rows}) == 5 and any(r[5] for r in rows)
    assert sum(r[2] == 0 for r in rows[:800]) > 70  # the site's silent end


def test_hourly_volume_in_one_run(spark, events, tmp_path):
    put(tmp_path / "events.parquet", 0, events)
    assert collected(hourly_volume(spark, str(tmp_path))) == expected(events)
