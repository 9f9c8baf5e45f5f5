import random

import pytest

from admeter.config import HOUR_MS, Settings
from admeter.operators import attribution as A
from admeter.operators.hot_keys import find_hot


def click(session, at, **more):
    return dict(event_id=f"c{at}", session_id=session, event_type="CLICK", event_timestamp_ms=at, **more)


def cart(session, at, **more):
    return dict(event_id=f"a{at}", session_id=session, event_type="ADD_TO_CART", event_timestamp_ms=at, **more)


def test_attributed(events):
    df = events([click("s1", 1000, campaign_id="camp", cost=0.5), cart("s1", 4000, tenant_id="t", user_id="u")])
    (r,) = A.conversions(df, Settings()).collect()
    assert (r.event_id, r.event_type, r.campaign_id, r.cost) == ("a4000_att", "CLICK_TO_BASKET", "camp", 0.5)
    assert (r.tenant_id, r.user_id, r.session_id, r.event_timestamp_ms) == ("t", "u", "s1", 4000)
    assert r.custom_tags == {"durationMs": "3000", "attributedClickId": "c1000"}


def test_outside_the_window(events):
    df = events([click("s2", 0), cart("s2", 7_200_000)])
    assert A.conversions(df, Settings(attribution_window_ms=HOUR_MS)).count() == 0
    assert A.conversions(df, Settings(attribution_window_ms=2 * HOUR_MS)).count() == 1


def test_only_the_first_cart(events):
    df = events([click("s3", 1000), cart("s3", 2000), cart("s3", 3000)])
    assert [r.event_id for r in A.conversions(df, Settings()).collect()] == ["a2000_att"]


def test_new_click_resets(events):
    df = events([click("s", 0), cart("s", 1), click("s", 2), cart("s", 3), cart("s", 4)])
    assert A.conversions(df, Settings()).count() == 2


def test_other_events_between_do_not_matter(events):
    view = dict(event_id="v", session_id="s", event_type="PRODUCT_VIEW", event_timestamp_ms=1)
    df = events([click("s", 0), view, cart("s", 2)])
    assert A.conversions(df, Settings()).count() == 1
    assert A.enrich(df, Settings()).count() == 4


def test_null_session_never_converts(events):
    df = events([click(None, 0), cart(None, 1)])
    assert A.conversions(df, Settings()).count() == 0
    assert A.enrich(df, Settings()).count() == 2


def test_keys_are_a_parameter(events):
    df = events([click("s", 0, tenant_id="t1"), cart("s", 1, tenant_id="t2")])
    assert A.conversions(df, Settings()).count() == 1
    assert A.conversions(df, Settings(), ["tenant_id", "session_id"]).count() == 0


def model(rows, window):
    """Last click and guard per session, one event after the other."""
    last, taken, out = {}, set(), []
    for r in sorted(rows, key=lambda r: (r["event_timestamp_ms"], r["seq"])):
        s = r["session_id"]
        if r["event_type"] == "CLICK":
            last[s] = r
            taken.discard(s)
        elif r["event_type"] == "ADD_TO_CART" and s in last and s not in taken:
            delta = r["event_timestamp_ms"] - last[s]["event_timestamp_ms"]
            if 0 <= delta <= window:
                taken.add(s)
                out.append((r["seq"], last[s]["event_id"], delta))
    return sorted(out)


@pytest.mark.parametrize("hot_rows", [10**9, 150, 20])
def test_against_sequential_model(events, hot_rows):
    """One session holds a third of the rows, many at the same instant; ranges cut it up."""
    rng = random.Random(hot_rows)
    rows = []
    for seq in range(3000):
        session = "hot" if rng.random() < 0.34 else f"s{rng.randrange(60)}"
        at = 5000 if rng.random() < 0.2 else rng.randrange(0, 400_000)
        kind = rng.choice(["CLICK", "ADD_TO_CART", "ADD_TO_CART", "IMPRESSION"])
        rows.append(
            dict(event_id=f"e{seq}", session_id=session, event_type=kind, event_timestamp_ms=at, seq=seq)
        )
    settings = Settings(attribution_window_ms=1500, hot_key_rows=hot_rows, hot_key_sample=1.0)
    df = events(rows)
    hot = find_hot(df, A.SESSION, settings)
    assert (hot is None) == (hot_rows == 10**9)
    want = model(rows, 1500)
    for out in (
        A.conversions(df, settings, hot=hot),
        A.enrich(df, settings, hot=hot).where("event_type = 'CLICK_TO_BASKET'"),
    ):
        got = out.select("seq", A.attributed_click().alias("c"), A.duration_ms().alias("d"))
        assert sorted((r.seq, r.c, r.d) for r in got.collect()) == want
