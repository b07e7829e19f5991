import os
import random

from conftest import obs_frame
from scrubjay.operators import history as H
from scrubjay.sources.storage import SnapshotStore


def _rows(seed, n):
    rnd = random.Random(seed)
    return [(i, rnd.choice([None, "a", "b", "SYNC: x", f"t{i}", "c"]), None if rnd.random() < 0.1 else f"2024-01-{1 + rnd.randrange(9):02d} 0{rnd.randrange(3)}:00:00")
            for i in range(n)]


def test_state_in_parts_equals_backfill(spark, tmp_dir):
    """Days added later, late rows, tied times, rows without text or time, an empty part."""
    rows = _rows(5, 120)
    store = SnapshotStore(spark, os.path.join(tmp_dir, "state"))
    parts = [rows[:50], [], rows[50:110], rows[110:]]
    for i, part in enumerate(parts):
        assert H.extend_history(store, obs_frame(spark, part) if part else obs_frame(spark, rows).limit(0)) == i + 1
    got = {r.run_ts: r.asDict() for r in H.history_from_state(store.read()).collect()}
    want = {r.run_ts: r.asDict() for r in H.backfill_history(obs_frame(spark, rows)).collect()}
    assert got == want and len(want) > 5
    days = store.read().where("kind = 'day'")
    assert days.count() == days.select("date").distinct().count()
