"""Expiry timers against a state machine that takes one event at a time."""

import random
from datetime import datetime, timedelta

from labelforge.streaming import expiry

DAY = datetime(2024, 1, 1)


def test_timers_equal_one_event_at_a_time(spark, tmp_path):
    rng, hour = random.Random(5), lambda h: DAY + timedelta(hours=h)
    timers, state, exp = expiry.ExpiryTimers(f"file:{tmp_path}"), {}, []
    schema = "batch_id long, event string, ts timestamp_ntz, expires_at timestamp_ntz"
    for epoch in range(4):
        times = rng.sample(range(epoch * 100 + 1, epoch * 100 + 100), 60)
        events = [(rng.randrange(25), rng.choice(["assigned", "assigned", "completed", "released"]), hour(t), hour(t + rng.choice([5, 24, 130]))) for t in times]
        if epoch == 2:
            events.append((1, "assigned", hour(3), hour(900)))  # later than the watermark
        for b, event, ts, end in sorted(events, key=lambda e: e[2]):
            if ts < hour(epoch * 100):
                continue
            if event == "assigned":
                state[b] = end
            elif state.pop(b, None):
                exp.append((b, event, end))
        for b, end in [x for x in state.items() if x[1] < hour(epoch * 100 + max(t - epoch * 100 for t in times))]:
            exp.append((b, "expired", end))
            del state[b]
        for _ in (0, 1):  # a replayed micro-batch changes nothing
            timers.process_batch(spark.createDataFrame(events, schema).repartition(3), epoch)
    got = [(r.batch_id, r.status, r.expires_at) for r in timers.outcomes(spark).collect()]
    assert sorted(got) == sorted(exp)
    assert {(r.batch_id, r.expires_at) for r in timers.open(spark, 3).collect()} == set(state.items())
