import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from admeter.config import Settings
from admeter.operators import dedup
from admeter.operators.hot_keys import find_hot

S1 = Settings(dedup_ttl_ms=1000)


def kept_ids(df):
    return sorted((r.event_id, r.event_timestamp_ms) for r in df.collect())


def model(rows, ttl):
    """One row after the other in (time, seq) order."""
    anchor, out = {}, []
    for r in sorted(rows, key=lambda r: (r["event_timestamp_ms"], r["seq"])):
        at = anchor.get(r["event_id"])
        if at is None or r["event_timestamp_ms"] - at > ttl:
            anchor[r["event_id"]] = r["event_timestamp_ms"]
            out.append(r["seq"])
    return sorted(out)


def test_duplicate_within_ttl(events):
    df = events([dict(event_id="e1", event_timestamp_ms=t) for t in (0, 100)])
    out = dedup.unique(df, S1, None)
    assert kept_ids(out) == [("e1", 0)]
    assert dedup.live_keys(out, replace(S1, as_of_ms=100)).first()[0] == 1


def test_expiry(events):
    df = events(
        [dict(event_id=i, event_timestamp_ms=t) for i, t in (("e1", 0), ("e2", 1500), ("e1", 1500))]
    )
    out = dedup.unique(df, S1, None)
    assert kept_ids(out) == [("e1", 0), ("e1", 1500), ("e2", 1500)]
    assert dedup.live_keys(out, replace(S1, as_of_ms=1500)).first()[0] == 2


def test_boundary_is_strict(events):
    df = events([dict(event_id="e", event_timestamp_ms=t) for t in (0, 1000, 1001)])
    assert kept_ids(dedup.unique(df, S1, None)) == [("e", 0), ("e", 1001)]


def test_duplicates_do_not_extend_the_anchor(events):
    df = events([dict(event_id="e", event_timestamp_ms=t) for t in range(0, 5000, 500)])
    assert [t for _, t in kept_ids(dedup.unique(df, S1, None))] == [0, 1500, 3000, 4500]


@pytest.mark.parametrize("hot_rows", [10**9, 200, 3])
@pytest.mark.parametrize("ttl", [1000, 40_000, 3_600_000])
def test_against_sequential_model(events, hot_rows, ttl):
    """Random ids; one of them holds a third of all rows and many rows share an instant."""
    rng = random.Random(hot_rows + ttl)
    rows = []
    for seq in range(1500):
        event_id = "hot" if rng.random() < 0.34 else f"e{rng.randrange(300)}"
        at = rng.choice([-5, 0, 70_000]) if rng.random() < 0.2 else rng.randrange(-10**5, 2 * 10**7)
        rows.append(dict(event_id=event_id, event_timestamp_ms=at, seq=seq))
    settings = Settings(dedup_ttl_ms=ttl, hot_key_rows=hot_rows, hot_key_sample=1.0)
    df = events(rows)
    hot = find_hot(df, ["event_id"], settings)
    assert (hot is None) == (hot_rows == 10**9)
    out = dedup.unique(df, settings, hot)
    assert sorted(r.seq for r in out.select("seq").collect()) == model(rows, ttl)


def test_tags_survive(events):
    df = events([dict(event_id="e", event_timestamp_ms=0, custom_tags={"a": "b"})] * 2)
    assert dedup.unique(df, S1, None).first().custom_tags == {"a": "b"}


def test_dropped_by_tenant(events):
    df = events(
        [dict(event_id="e", tenant_id=t, event_timestamp_ms=i) for i, t in enumerate("aab")]
    )
    out = dedup.dropped_by(df, dedup.unique(df, S1, None), ["tenant_id"])
    assert {(r.tenant_id, r.dropped) for r in out.collect()} == {("a", 1), ("b", 1)}


def test_first_per_id(events):
    df = events([dict(event_id="e", event_timestamp_ms=t, tenant_id=str(t)) for t in (5, 3, 3)])
    row = dedup.first_per_id(df, ["tenant_id"]).first()
    assert (row.event_timestamp_ms, row.seq, row.tenant_id) == (3, 1, "3")


def test_hot_path_folds_before_the_shuffle(events):
    """The heavy id never reaches the fold that holds an id's rows in one array."""
    settings = Settings(hot_key_rows=10, hot_key_sample=1.0)
    df = events([dict(event_id="hot", event_timestamp_ms=i) for i in range(50)])
    hot = find_hot(df, ["event_id"], settings)
    calm = dedup._fold(dedup.keep_keys(df, hot.table, hot.keys, ["event_id"], settings, "left_anti"), 10)
    assert calm.count() == 0
    assert dedup.unique(df, settings, hot).agg(F.count("*")).first()[0] == 1


def test_walk_equals_fold_with_nulls_and_ties(events):
    from admeter.operators import dedup

    t = 1_706_000_000_000
    rows = [dict(event_id="a", event_timestamp_ms=t, seq=None)] * 5
    rows += [dict(event_id="b", event_timestamp_ms=None, seq=i) for i in range(5)]
    rows += [dict(event_id="c", event_timestamp_ms=t + i * 1000, seq=s) for i, s in ((0, 4), (0, 4), (9, None), (9000, 2))]
    df = events(rows)
    fold, walk = (
        sorted(map(repr, (tuple(r) for r in f(df, 3_600_000).collect()))) for f in (dedup._fold, dedup._walk)
    )
    assert fold == walk and len(fold) == 1 + 5 + 2
