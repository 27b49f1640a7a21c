import datetime as dt
import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from times import at
from meterlake import savings_suggestions
from meterlake.operators import density, rules
from meterlake.operators.density import candidate_slots, densest_window, slot_counts

NOW = at("2026-06-20T12:00:00")


def spaced(count, step, start=NOW - dt.timedelta(days=10), **columns):
    return [{"ts": start + i * step, **columns} for i in range(count)]


SECOND, MINUTE, HOUR = dt.timedelta(seconds=1), dt.timedelta(minutes=1), dt.timedelta(hours=1)
# One case at the limit of each rule, and cases just beyond it that must give nothing.
DOWNGRADED = spaced(rules.MIN_CALLS, MINUTE, project="tagging", model="large-a", input_tokens=700, output_tokens=rules.MEDIAN_OUTPUT_MAX - 1)
UNCACHED = spaced(rules.CACHE_MIN_REPEATS, HOUR, project="letters", model="medium", input_tokens=12_000, output_tokens=900)
BURST = spaced(rules.BATCH_MIN_CALLS, 30 * SECOND, project="mailing", model="medium", source="api", input_tokens=900, output_tokens=40)
AT_LIMITS = [*DOWNGRADED, *UNCACHED, *BURST]
BEYOND = [
    *[{**c, "project": "too few"} for c in DOWNGRADED[1:]],
    *[{**c, "project": "too long", "output_tokens": rules.MEDIAN_OUTPUT_MAX} for c in DOWNGRADED],
    *[{**c, "project": "too rare"} for c in UNCACHED[1:]],
    *[{**c, "project": "too small", "input_tokens": rules.CACHE_INPUT_MIN - 1} for c in UNCACHED],
    *[{**c, "project": "reads a cache", "cache_read_tokens": 1} for c in UNCACHED],
    *[{**c, "project": "one short"} for c in BURST[1:]],
    *[{**c, "project": "spread", "ts": NOW - dt.timedelta(days=9) + 2 * i * MINUTE} for i, c in enumerate(BURST)],
]


def test_cases_at_the_limits(usage, prices):
    found = savings_suggestions(usage(*AT_LIMITS, *BEYOND), prices, NOW).collect()
    # Micro-dollars: 100 calls at 700 * 5 + 299 * 25, or at 700 * 1 + 299 * 5; nine repeats of 12,000 tokens at nine
    # tenths of 3 less one cache write; half of 100 calls at 900 * 3 + 40 * 15.
    assert [(r.rule, r.project, r.estimated_monthly_savings_usd, r.confidence) for r in found] == [
        ("model_downgrade", "tagging", Decimal("0.88"), "high"),
        ("missing_prompt_cache", "letters", Decimal("0.25"), "medium"),
        ("batch_candidates", "mailing", Decimal("0.17"), "medium"),
    ]
    assert [r.detail for r in found] == [
        "calls=100 median_output_tokens=299 usd_now=$1.10 usd_on_target=$0.22 usd_saved_monthly=$0.88 percent_saved=80",
        "calls=10 model=medium input_tokens_each=12000 input_tokens_repeated=108000 usd_saved_monthly=$0.25",
        "direct_calls=100 window_minutes=60 most_calls_in_window=100 usd_saved_monthly=$0.17",
    ]


def test_nothing_beyond_the_limits(usage, prices):
    assert savings_suggestions(usage(*BEYOND), prices, NOW).count() == 0
    assert savings_suggestions(usage(*AT_LIMITS).where("false"), prices, NOW).count() == 0


def test_window_filters_and_scale(usage, prices):
    events = usage(*AT_LIMITS)
    assert savings_suggestions(events, prices, NOW, project="letters").count() == 1
    assert savings_suggestions(events, prices, NOW, model="large-a").count() == 1
    assert savings_suggestions(events, prices, NOW, lookback_days=9).count() == 0
    part = savings_suggestions(events, prices, NOW, start=NOW - dt.timedelta(days=12), project="tagging")
    assert part.first().estimated_monthly_savings_usd == Decimal("2.20")


def test_downgrade_limits(usage, prices):
    calls = DOWNGRADED

    def count(rows, **limits):
        return rules.model_downgrade(usage(*rows), prices, 30.0, **limits).count()

    assert count(calls) == 1
    assert count(calls[:99]) == 0 and count(calls[:99], min_calls=99) == 1
    assert count([{**c, "output_tokens": 300} for c in calls]) == 0
    assert count([{**c, "output_tokens": 299 if i % 2 else 300} for i, c in enumerate(calls)]) == 1
    assert count([{**c, "input_tokens": 10 if i % 2 else 5000} for i, c in enumerate(calls)]) == 0
    assert count([{**c, "input_tokens": 0} for c in calls]) == 0
    assert count([{**c, "model": "small"} for c in calls]) == 0
    assert count([{**c, "model": "LARGE-legacy"} for c in calls]) == 1
    assert count(calls, target="unknown") == 0
    # What already costs no more than the target saves nothing.
    assert count([{**c, "model": "small"} for c in calls], family=("small",)) == 0


def test_clamped_median_is_the_median(spark, usage, prices):
    """Groups on both sides of the limit, with outputs far above it."""
    random.seed(5)
    rows, want = [], {}
    for number in range(40):
        outputs = [random.choice([random.randint(0, 320), random.randint(250, 700), 10**9]) for _ in range(random.randint(1, 9))]
        want[f"p{number}"] = statistics.median(outputs)
        rows += [{"project": f"p{number}", "model": "large-a", "input_tokens": 5000, "output_tokens": o} for o in outputs]
    groups = rules.downgrade_groups(usage(*rows), F.lit(Decimal("0.0")), ("large",), min_calls=1)
    got = {r.project: r.median_output for r in groups.collect()}
    assert got == {p: m for p, m in want.items() if m < 300}


def test_cache_buckets_and_first_call(usage, prices):
    rows = [
        {"ts": NOW - HOUR, "project": None, "model": "medium", "input_tokens": 2250},
        *spaced(9, MINUTE, project="", model="medium", input_tokens=2249),
        *spaced(9, MINUTE, start=NOW - 2 * HOUR, project="rare", model="medium", input_tokens=9000),
        *spaced(12, MINUTE, project="short", model="medium", input_tokens=1999),
    ]
    group = rules.cache_groups(usage(*rows)).collect()
    # 2250 / 500 is 4.5, which goes to the even 4; missing and empty names are one group.
    assert [(r.project, r.input_bucket, r.calls, r.repeated_input_tokens) for r in group] == [
        ("", 2000, 10, 8 * 2249 + 2250)
    ]
    saved = rules.missing_prompt_cache(usage(*rows), prices, 30.0).first().saving_usd
    assert saved == (Decimal(8 * 2249 + 2250) * 3 * Decimal("0.9") - Decimal(2000 * 3) * Decimal("1.25")) / 10**6


def test_cache_rate_of_unknown_model_is_the_fallback(usage, prices):
    rows = spaced(10, MINUTE, project="x", model="unlisted", input_tokens=8000)
    same = spaced(10, MINUTE, project="x", model="medium", input_tokens=8000)
    unknown, known = (rules.missing_prompt_cache(usage(*r), prices, 30.0).first().saving_usd for r in (rows, same))
    assert unknown == known > 0


def brute_force(times, window):
    return max(sum(1 for t in times if end - window <= t <= end) for end in times)


@pytest.mark.parametrize("seed", range(4))
def test_densest_window_equals_brute_force(spark, seed):
    """Hot groups, bursts, equal instants, exact window edges, negative times."""
    random.seed(seed)
    base = at("1969-12-31T20:00:00") if seed == 0 else at("2026-06-20T00:00:00")
    window = dt.timedelta(minutes=60)
    rows = []
    for project in ("hot", "even", "burst", "edge", "one"):
        count = {"hot": 300, "even": 60, "burst": 80, "edge": 40, "one": 1}[project]
        for i in range(count):
            offset = {
                "hot": dt.timedelta(microseconds=random.randint(0, 6 * 3600 * 10**6)),
                "even": i * dt.timedelta(minutes=3),
                "burst": dt.timedelta(seconds=random.choice([0, 30, 3599, 3600, 3601, 7200])),
                "edge": i // 10 * dt.timedelta(minutes=60) + dt.timedelta(microseconds=random.choice([-1, 0, 1])),
                "one": dt.timedelta(0),
            }[project]
            rows.append((project, base + offset))
    events = spark.createDataFrame(rows, "project string, ts timestamp")
    want = {p: brute_force([t for q, t in rows if q == p], window) for p in {p for p, _ in rows}}
    assert {r.project: r.max_in_window for r in densest_window(events, "project", 60).collect()} == want
    for look_rows in (0, 5, 40):
        assert {r.project: r.max_in_window for r in densest_window(events, "project", 60, look_rows=look_rows).collect()} == want
    limited = densest_window(events, "project", 60, min_calls=30)
    assert {r.project: r.max_in_window for r in limited.collect()} == {p: n for p, n in want.items() if n >= 30}


@pytest.mark.parametrize("minutes", (1, 7, 60))
def test_slots_are_cut_until_they_fit(spark, minutes, monkeypatch):
    """All events in one minute, then in one instant: a look has no more rows than a cut has parts."""
    random.seed(minutes)
    base, seen = at("2026-06-20T00:00:00"), []
    counts = density._part_counts

    def watched(events, ends, key, window, width, part):
        found = counts(events, ends, key, window, width, part)
        seen.append((width // part, found.groupBy(key, "end_slot").count().agg(F.max("count")).first()[0]))
        return found

    monkeypatch.setattr(density, "_part_counts", watched)
    burst = [base + dt.timedelta(microseconds=random.randint(0, 59_999_999)) for _ in range(4000)]
    for times in (burst, [base] * 3000):
        seen.clear()
        events = spark.createDataFrame([("p", t) for t in times], "project string, ts timestamp")
        want = brute_force(times, dt.timedelta(minutes=minutes))
        assert [r.max_in_window for r in densest_window(events, "project", minutes, look_rows=50).collect()] == [want]
        assert all(rows <= max(parts, 50) for parts, rows in seen[:-1]) and seen[-1][1] <= 1000
    assert (len(seen), seen[-1][1]) == (4 if minutes > 1 else 3, 1)


def test_most_slots_are_ruled_out(spark):
    rows = [("p", at("2026-06-01") + i * dt.timedelta(minutes=7)) for i in range(500)]
    rows += [("p", at("2026-06-02") + i * dt.timedelta(seconds=1)) for i in range(100)]
    slots = slot_counts(spark.createDataFrame(rows, "project string, ts timestamp"), "project", 60)
    assert candidate_slots(slots, "project", 1).count() < 0.05 * slots.count()


def test_batch_rule_ignores_batches_and_other_sources(usage, prices):
    rows = spaced(130, 5 * SECOND, project="p", model="medium", source="api", input_tokens=700)
    assert rules.batch_candidates(usage(*rows), prices, 30.0).count() == 1
    assert rules.batch_candidates(usage(*[{**r, "is_batch": True} for r in rows]), prices, 30.0).count() == 0
    assert rules.batch_candidates(usage(*[{**r, "source": "session_log"} for r in rows]), prices, 30.0).count() == 0
    assert rules.batch_candidates(usage(*rows[:99]), prices, 30.0).count() == 0
    # One dense window qualifies all calls of the project.
    late = spaced(20, HOUR, start=NOW - dt.timedelta(days=5), project="p", model="medium", source="api", input_tokens=700)
    found = rules.batch_candidates(usage(*rows, *late), prices, 30.0).first()
    assert (found.calls, found.saving_usd) == (150, Decimal("0.1575"))
