"""Champions, the ledger of committed batches, and replays, against loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from monthmill.operators import champions, replay as rp
from monthmill.sources.ledger import Ledger, content_id, versioned

EVENTS = ("scope string, at timestamp, seq long, version string, expected string, actor string, certified boolean, gate_ready boolean, "
          "comment_length int, k int, outcome_note string")


def test_publications_against_a_loop(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        rows.append((f"s{rng.randrange(3)}", dt.datetime(2024, 1, 1 + rng.randrange(28)), i, rng.choice(["a", "b", "c", None]) if i % 17 == 0 else rng.choice("abc"),
                     rng.choice([None, None, "a", "b", "c"]), None if i % 13 == 0 else "me", rng.random() < 0.9 if i % 29 else None, rng.random() < 0.9,
                     rng.choice([4, 5, 60]) if i % 31 else None, 7, "x"))
    out = {r["seq"]: r for r in champions.publications(spark.createDataFrame(rows, EVENTS).repartition(5), ["scope"]).collect()}
    assert len(out) == len(rows)
    now, last = {}, {}
    for scope, at, seq, version, expected, actor, certified, ready, comment, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        r, reason = out[seq], None
        if actor is None:
            reason = "UNAUTHORISED"
        elif not certified:
            reason = "UNCERTIFIED"
        elif not ready:
            reason = "GATE_NOT_READY"
        elif (comment or 0) < 5:
            reason = "COMMENT_TOO_SHORT"
        elif version is None:
            reason = "NO_VERSION"
        if reason:
            assert (r["outcome"], r["reason"]) == ("REFUSED", reason)
        elif now.get(scope) == version:
            assert r["outcome"] == "UNCHANGED"
        elif expected is not None and expected != now.get(scope):
            assert (r["outcome"], r["reason"]) == ("REFUSED", "STALE_PREDECESSOR")
        else:
            assert (r["outcome"], r["previous_version"]) == ("PUBLISHED", now.get(scope))
            if scope in last:
                assert out[last[scope]]["valid_to"] == at
            now[scope], last[scope] = version, seq
    spans = champions.in_force(champions.publications(spark.createDataFrame(rows, EVENTS), ["scope"]))
    active = {r["scope"]: r["version"] for r in spans.filter("status = 'ACTIVE'").collect()}
    assert active == now
    # one champion at most at any time, and the one whose interval holds it
    moments = spark.createDataFrame([("s0", dt.datetime(2024, 1, d, 12)) for d in range(1, 29)] + [("none", dt.datetime(2024, 1, 5))], "scope string, moment timestamp")
    held = champions.champion_at(moments, champions.publications(spark.createDataFrame(rows, EVENTS), ["scope"]), ["scope"], "moment").collect()
    want, current = {}, None
    published = sorted((r for r in out.values() if r["outcome"] == "PUBLISHED" and r["scope"] == "s0"), key=lambda r: (r["at"], r["seq"]))
    for d in range(1, 29):
        current = next((r["version"] for r in reversed(published) if r["at"] <= dt.datetime(2024, 1, d, 12)), None)
        want[d] = current
    assert len(held) == 29 and {r["moment"].day: r["champion_version"] for r in held if r["scope"] == "s0"} == want
    assert [r["champion_version"] for r in held if r["scope"] == "none"] == [None]
    assert champions.publications(spark.createDataFrame([], EVENTS), ["scope"]).collect() == []


FACTS = "id long, period string, value double, note string"


def test_ledger_shows_whole_batches_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "facts"))
    rows = spark.createDataFrame([(i, f"2024-{i % 3 + 1:02d}", float(i), None if i % 4 else "x") for i in range(60)], FACTS)
    assert ledger.read(rows.schema).collect() == [] and ledger.manifests() == []
    first = ledger.commit(rows)
    # the same content in another order and another number of files
    assert ledger.commit(rows.orderBy(F.desc("value")).repartition(5))["folder"] == first["folder"]
    # a batch that breaks off before its manifest is not there
    ledger.stage(rows.withColumn("value", F.lit(-1.0)))
    assert ledger.read(rows.schema).count() == 60 and ledger.read(rows.schema).filter("value < 0").count() == 0
    second = ledger.append_new(rows.withColumn("id", F.col("id") + 50), ["id"], ["value"])
    got = ledger.read(rows.schema)
    assert second["batch"] == 2 and {r["batch"]: r["count"] for r in got.groupBy("batch").count().collect()} == {1: 60, 2: 50}
    assert got.select("id").distinct().count() == 110
    with pytest.raises(RuntimeError, match="another writer"):
        ledger.publish(ledger.stage(rows), "other", 2)
    assert ledger.read(rows.schema).count() == 110


def test_content_tells_rows_apart_but_not_their_order(spark):
    kind = "a string, b string, c double"
    one = [("x", None, 1.0), (None, "x", 1.0), ("x", None, 1.0)]
    ids = {content_id(spark.createDataFrame(rows, kind)) for rows in (one, one[::-1])}
    others = {content_id(spark.createDataFrame(rows, kind)) for rows in (one[:2], [one[0]] * 3, [(None, "x", 1.0)] * 2 + one[:1], [], [("x", "x", None)] * 3)}
    assert len(ids) == 1 and len(others) == 5 and not ids & others


def test_versions_go_on_from_what_is_there(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "versions"))
    kind = "key string, value double"
    batches = [[("a", 1.0), ("b", 2.0), ("a", 3.0)], [("a", 9.0), ("c", 1.0)], [("b", 5.0)]]
    stored = {}
    for i, rows in enumerate(batches):
        for _ in range(2):  # each batch is confirmed twice
            ledger.append_versions(spark.createDataFrame(rows, kind), ["key"], ["value"], f"2024-01-0{i + 1}")
        for k, v in sorted(rows, key=lambda r: r[1]):
            stored.setdefault(k, []).append((v, i + 1))
    got = {}
    for r in ledger.read(versioned(spark.createDataFrame([], kind))).orderBy("key", "version_no").collect():
        got.setdefault(r["key"], []).append((r["value"], r["available_at"].day))
        assert r["version_no"] == len(got[r["key"]])
    assert got == stored


def test_replay_sees_what_was_known_and_carries_the_rest(spark):
    """Facts that arrive late, corrected ones and months in which nothing arrives."""
    rng = random.Random(6)
    month = lambda i: dt.date(2022 + i // 12, i % 12 + 1, 1)
    rows = []
    for scope, first, late in (("a", 0, 0), ("b", 3, 4)):
        for i in range(first, 20):
            for product in ("p", "q"):
                v = float(rng.randint(5, 60))
                arrives = i + 1 + (late if i > 14 else 0) - (i % 3 == 2 and scope == "b") * 0
                rows.append((scope, product, month(i), 1, v, month(arrives)))
                if i % 5 == 0:
                    rows.append((scope, product, month(i), 2, v + 3 if i % 10 else v, month(arrives + 2)))
    kind = "scope string, product string, period date, ver int, v double, av date"
    end = month(26)
    known = rp.known_totals(spark.createDataFrame(rows, kind), ["scope"], ["product"], "period", "av", ["ver"], "v")
    out = {(r["scope"], r["cutoff"]): r for r in rp.replay(known, ["scope"], end).collect()}
    carried = 0
    for scope in "ab":
        own, held, since = [r for r in rows if r[0] == scope], None, None
        first = min(r[5] for r in own)
        for cutoff in rp.months_between(first, end):
            latest = {}
            for _, product, period, ver, v, av in sorted(own, key=lambda r: (r[5], r[3])):
                if av <= cutoff:
                    latest[product, period] = v
            history = {}
            for (_, period), v in latest.items():
                history[period] = history.get(period, 0.0) + v
            if history != held:
                held, since = history, cutoff
            r = out.pop((scope, cutoff))
            assert r["run_cutoff"] == since and r["carried"] == (since != cutoff) and r["n"] == len(history)
            assert r["status"] == ("COMPLETED" if len(history) >= 7 else "SKIPPED_INSUFFICIENT_HISTORY")
            carried += r["carried"]
            if r["status"] == "COMPLETED":
                assert r["last_month"] == max(history) and len(r["forecast"]) == 12 and len(r["residuals"]) == len(history) - 6
                if r["winner"] == "Naive":
                    assert r["forecast"] == [math.floor(history[max(history)] * 100 + 0.5) / 100] * 12
            else:
                assert r["forecast"] is None
    assert out == {} and carried > 5
