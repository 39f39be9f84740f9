from datetime import datetime, timedelta

import pytest

from modelkeel.operators import registry as r

T0 = datetime(2024, 1, 1)


def promotions(spark, versions, name="uc-m"):
    rows = [(name, v, T0 + timedelta(hours=i), i, "manual") for i, v in enumerate(versions)]
    return spark.createDataFrame(rows, "name string, version int, ts timestamp, n int, trigger string")


def events(spark, versions):
    return r.promotion_events(promotions(spark, versions), ["ts", "n"])


@pytest.mark.parametrize("versions, champion, previous", [
    ([1], 1, None), ([1, 2], 2, 1), ([1, 2, 2], 2, 1), ([1, 2, 1], 1, 2), ([3, 3, 3], 3, None), ([1, 2, 3, 2, 2], 2, 3),
])
def test_aliases_after_promotions(spark, versions, champion, previous):
    log = events(spark, versions)
    current = {x["alias"]: x["version"] for x in r.current_aliases(log, ("ts", "n", "seq")).collect()}
    assert current.get("champion") == champion and current.get("previous") == previous
    short = r.previous_champion(promotions(spark, versions), ("ts", "n")).first()
    assert (short["champion"], short["previous"]) == (champion, previous)
    back = r.rollback_targets(log, ("ts", "n", "seq")).first()
    assert back["version"] == previous
    assert (back["error"] is None) == (previous is not None)


def test_promotions_continue_after_known_champions(spark):
    before = spark.createDataFrame([("uc-m", 4)], "name string, version int")
    log = r.promotion_events(promotions(spark, [5]), ["ts", "n"], before).collect()
    assert [(x["alias"], x["version"]) for x in sorted(log, key=lambda x: x["seq"])] == [("previous", 4), ("champion", 5)]
    assert r.promotion_events(promotions(spark, [4]), ["ts", "n"], before).count() == 1


def test_versions_are_numbered_after_existing_ones(spark):
    new = promotions(spark, [0, 0, 0]).unionByName(promotions(spark, [0], "other")).drop("version")
    have = spark.createDataFrame([("uc-m", 7)], "name string, version int")
    got = sorted((x["name"], x["n"], x["version"]) for x in r.next_versions(new, ["ts", "n"], have).collect())
    assert got == [("other", 0, 1), ("uc-m", 0, 8), ("uc-m", 1, 9), ("uc-m", 2, 10)]


def test_lineage_of_a_lost_run_is_empty(spark):
    versions = spark.createDataFrame([("a", "r1"), ("a", "r2")], "name string, run_id string")
    runs = spark.createDataFrame([("r1", {"data_hash": "h"})], "run_id string, tags map<string,string>")
    got = {x["run_id"]: (x["data_hash"], x["git_commit"]) for x in r.with_lineage(versions, runs).collect()}
    assert got == {"r1": ("h", ""), "r2": ("", "")}


def test_retrain_only_when_nothing_is_in_flight(spark):
    levels = spark.createDataFrame([("u", "a", "retrain"), ("u", "b", "retrain"), ("u", "c", "warn")], "use_case string, model string, level string")
    runs = spark.createDataFrame([("u", "a", "Running"), ("u", "b", "Succeeded"), ("u", "c", None)], "use_case string, model string, phase string")
    assert [x["model"] for x in r.retrain_requests(levels, runs).collect()] == ["b"]
    fresh = runs.unionByName(spark.createDataFrame([("u", "b", "")], runs.schema))
    assert r.retrain_requests(levels, fresh).count() == 0


def test_champion_as_of_a_time(spark):
    """Records and events with ties, a hot model cut into chunks, models without events and events without records."""
    import random
    from datetime import datetime, timedelta

    from modelkeel.operators import registry as reg

    rng, t0 = random.Random(6), datetime(2024, 1, 1)
    events = [(rng.choice(["hot", "hot", "b", "only events"]), "champion", rng.randint(1, 4), rng.randint(0, 200), i) for i in range(60)]
    events += [("hot", "previous", 99, 50, 1000)]
    records = [(rng.choice(["hot", "hot", "hot", "b", "none", None]), rng.choice([7, rng.randint(0, 220)]), i) for i in range(500)]
    at = lambda s: t0 + timedelta(seconds=s)
    ev = spark.createDataFrame([(n, a, v, at(s), q) for n, a, v, s, q in events], "name string, alias string, version int, ts timestamp_ntz, seq long")
    rec = spark.createDataFrame([(n, at(s), i) for n, s, i in records], "name string, ts timestamp_ntz, id long")

    def known(name, s):
        past = [(q[3], q[4], q[2]) for q in events if q[0] == name and q[1] == "champion" and q[3] <= s]
        return max(past)[2] if past else None

    want = {i: known(n, s) for n, s, i in records}
    for size in (15, 10**6):
        rows = reg.champion_as_of(rec, ev, rows_per_chunk=size)
        assert rows.columns == ["name", "ts", "id", "champion"]
        assert {r["id"]: r["champion"] for r in rows.collect()} == want
    spans = reg.validity(ev).collect()
    assert all(r["valid_to"] is None or r["valid_from"] < r["valid_to"] for r in spans)
    for n, s, i in records:
        held = [r["version"] for r in spans if r["name"] == n and r["valid_from"] <= at(s) and (r["valid_to"] is None or at(s) < r["valid_to"])]
        assert held == ([want[i]] if want[i] is not None else [])
