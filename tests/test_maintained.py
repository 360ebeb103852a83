"""Kept roll-ups equal the full ones after any sequence of changes."""

import random

from storyloom.operators import maintained
from storyloom.operators.rollups import story_article_counts, story_feed_counts, story_importance_avg
from storyloom.session import stored

SCHEMA = "id long, event_id long, feed_source_id long, importance_score double"


def test_any_sequence_of_changes(spark):
    rng = random.Random(3)
    row = lambda i: (i, rng.choice([None, 1, 2, 3]), rng.choice([None, 7, 8]), rng.choice([None, 0.1, 0.7, 1 / 3]))
    rows = {i: row(i) for i in range(40)}
    frame = lambda some: spark.createDataFrame(list(some), SCHEMA)
    kept = stored(maintained.kept_rollup(frame(rows.values())))
    for step in range(6):
        touched = rng.sample(sorted(rows), 10)
        before = [rows[i] for i in touched]
        for i in touched:  # moved, rescored, deleted
            rows[i] = row(i)
            if rng.random() < 0.3:
                del rows[i]
        fresh = {1000 * step + k: row(1000 * step + k) for k in range(100, 104)}
        rows |= fresh
        after = [rows[i] for i in [*touched, *fresh] if i in rows]
        if step == 4:  # a story loses all it had
            before, after = [*before, *(r for i, r in rows.items() if r[1] == 2 and i not in touched and i not in fresh)], [r for r in after if r[1] != 2]
            rows = {i: r for i, r in rows.items() if r[1] != 2}
        kept = stored(maintained.maintained(kept, maintained.rollup_changes(frame(before), frame(after))))
        assert step != 4 or kept.where("event_id = 2").isEmpty()
        whole = frame(rows.values())
        assert sorted(kept.collect(), key=repr) == sorted(maintained.kept_rollup(whole).collect(), key=repr)
    want = story_article_counts(whole).join(story_feed_counts(whole), "event_id", "left").join(story_importance_avg(whole), "event_id")
    want = {r.event_id: (r.article_count, r.feed_count or 0, round(r.importance_avg, 9)) for r in want.collect()}
    assert {r.event_id: (r.article_count, r.feed_count, round(r.importance_avg, 9)) for r in maintained.story_totals(kept).collect()} == want
    assert maintained.rollup_changes(whole, whole).count() == 0
