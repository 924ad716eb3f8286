from datetime import datetime, timedelta

from brookmill.operators.sla import Policy, replayed

T0 = 1_700_000_000_000
P = Policy(240_000, 900_000)


def ev(status, s, zone="Z"):
    return (status, T0 + s * 1000, zone, "R1")


def test_open_order_waits_for_its_deadline():
    step = P.events(None, [ev("PLACED", 0)], 0)
    assert step.timer == T0 + 240_000 and not step.alerts and step.state.placed == T0


def test_breach_then_late_delivery():
    step = P.events(None, [ev("PLACED", 0)], 0)
    fired = P.fired(step.state, T0 + 250_000)
    assert fired.alerts == (("SLA_BREACH", T0 + 250_000, 250_000),) and fired.timer == T0 + 900_000
    done = P.events(fired.state, [ev("DELIVERED", 300)], T0 + 250_000)
    assert done.alerts == (("DELIVERED_AFTER_BREACH", T0 + 300_000, 300_000),)
    assert P.events(done.state, [ev("DELIVERED", 310)], 0).alerts == ()


def test_delivery_in_time_and_tombstone():
    step = P.events(None, [ev("PLACED", 0), ev("DELIVERED", 100)], 0)
    assert step.state.closed and step.timer == T0 + 1_000_000 and not step.alerts
    late = P.events(step.state, [ev("PICKED_UP", 90)], 0)
    assert late.state.status == "DELIVERED" and late.state.closed
    assert P.fired(late.state, T0 + 10**7).state is None


def test_late_in_event_time_but_before_the_timer_is_no_breach():
    step = P.events(None, [ev("PLACED", 0), ev("DELIVERED", 600)], 0)
    assert not step.alerts


def test_cancelled_after_breach_is_silent():
    state = P.fired(P.events(None, [ev("PLACED", 0)], 0).state, T0 + 250_000).state
    assert P.events(state, [ev("CANCELLED", 300)], 0).alerts == ()


def test_out_of_order_start():
    step = P.events(None, [ev("ACCEPTED", 60)], 0)
    assert step.timer == T0 + 60_000 + 240_000
    step = P.events(step.state, [ev("PLACED", 0)], 0)
    assert step.timer == T0 + 240_000 and step.state.status == "ACCEPTED"


def test_timers_are_never_in_the_past_and_breached_state_expires():
    step = P.events(None, [ev("PLACED", 0)], T0 + 10**6)
    assert step.timer == T0 + 10**6 + 1
    fired = P.fired(step.state, T0 + 10**6)
    assert P.fired(fired.state, T0 + 10**7).state is None


def test_place_is_of_the_first_event_and_unknown_statuses_rank_lowest():
    step = P.events(None, [ev("ODD", 5, "Z2"), ev("PLACED", 0, "Z1")], 0)
    assert step.state.zone == "Z1" and step.state.status == "PLACED"
    assert P.events(None, [], 0).state is None


def test_replay_gives_the_alerts_of_each_history(spark):
    at = lambda s: datetime(2026, 1, 15, 10) + timedelta(seconds=s)
    histories = {
        "in time": [("PLACED", 0), ("DELIVERED", 100)],
        "late": [("PLACED", 0), ("PICKED_UP", 50), ("DELIVERED", 300)],
        "on the second": [("PLACED", 0), ("DELIVERED", 240)],
        "open": [("PLACED", 0), ("ACCEPTED", 30)],
        "cancelled late": [("PLACED", 0), ("CANCELLED", 500)],
        "forgotten": [("PLACED", 0), ("DELIVERED", 901)],
    }
    rows = [(k, status, at(s), "Z", "R") for k, h in histories.items() for status, s in h] + [(None, "PLACED", at(0), "Z", "R"), ("no time", "PLACED", None, "Z", "R")]
    df = spark.createDataFrame(rows, "order_id string, status string, event_ts timestamp, zone string, restaurant_id string").repartition(5)
    got = sorted((r["order_id"], r["alert_type"], r["last_status"], r["detected_at"], r["open_seconds"]) for r in replayed(df, 240, 900).collect())
    breach = lambda k, status: (k, "SLA_BREACH", status, at(240), 240.0)
    assert got == sorted([breach("late", "PICKED_UP"), ("late", "DELIVERED_AFTER_BREACH", "DELIVERED", at(300), 300.0), breach("open", "ACCEPTED"), breach("cancelled late", "PLACED"), breach("forgotten", "PLACED")])
    assert replayed(df.where("false"), 240, 900).count() == 0
