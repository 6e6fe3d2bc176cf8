"""Champion records, alert files with bad lines, routed questions and refusals."""

from __future__ import annotations

import pytest
from oracle import SF
from pyspark.sql import functions as F

from tramline.operators import champion as P
from tramline.operators import questions as K
from tramline.sources import alert_log as L
from tramline.sources.adapters import legs_from_events
from tramline.streaming import events as E
from tramline.streaming import job as J


def metrics(spark, **mae):
    return spark.createDataFrame(list(mae.items()), "model string, mae double")


def test_only_a_better_challenger_takes_the_place(spark, tmp_path):
    path = str(tmp_path / "c")
    assert P.champion(spark, path) == (0, None, None)
    assert P.promote(spark, path, metrics(spark, b=30.0, a=30.0, c=31.0), 0)
    assert P.champion(spark, path) == (1, "a", 30.0)
    assert not P.promote(spark, path, metrics(spark, d=30.0), 1) and not P.promote(spark, path, metrics(spark, d=35.0), 2)
    assert P.promote(spark, path, metrics(spark, e=29.5), 3)
    assert P.champion(spark, path) == (2, "e", 29.5)
    got = [tuple(r) for r in P.history(spark, path).orderBy("round").select("round", "promoted", "challenger", "champion", "version", "reason").collect()]
    assert got == [
        (0, True, "a", None, 1, "no champion on record"), (1, False, "d", "a", 1, "error not smaller"), (2, False, "d", "a", 1, "error not smaller"),
        (3, True, "e", "a", 2, "smaller error"),
    ]
    with pytest.raises(ValueError, match="no challenger"):
        P.promote(spark, path, metrics(spark, x=1.0).where("false"), 4)


def test_a_promotion_against_an_old_version_is_refused(spark, tmp_path):
    path = str(tmp_path / "c")
    P.promote(spark, path, metrics(spark, a=30.0), 0)
    seen = P.champion(spark, path)
    assert P.promote(spark, path, metrics(spark, fast=29.0), 1, seen)
    with pytest.raises(P.Outpaced):
        P.promote(spark, path, metrics(spark, slow=29.5), 2, seen)
    assert P.champion(spark, path) == (2, "fast", 29.0) and P.history(spark, path).count() == 2


def test_reporting_rule(spark):
    c = spark.createDataFrame([("m1", "spark", 31.0, 30.0), ("m2", "single", 30.5, 33.0), ("m3", "spark", 30.9, 32.0)], "model string, library string, validation_mae double, test_mae double")
    r = P.reporting_rule(c, "spark").first()
    assert tuple(r) == ("m2", "single", 30.5, 33.0, "m3", 32.0)


def test_bad_lines_are_counted_and_set_aside(spark, tmp_path):
    one = ['{"alert_id":"a","alerted_at":"2024-01-01T00:00:00","gap":1.5}', '{"alert_id":"a","alerted_at":"2024-01-02T00:00:00","gap":2}', "", '{"alert_id":"b",', "nonsense", "[1, 2]"]
    two = ['{"alert_id":"c","alerted_at":"2024-01-01T00:00:00","gap":"x"}', '{"alert_id":"d","alerted_at":"2024-01-01T00:00:00"}', '{"alert_id":"e","alerted_at":"2024-01-01T00:00:00","gap":3,"more":1}']
    (tmp_path / "in").mkdir()
    for name, lines in (("one.jsonl", one), ("two.jsonl", two)):
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
    rows = L.read_lines(spark, str(tmp_path / "in"), "alert_id string, alerted_at timestamp, gap double")
    need = ["alert_id", "alerted_at", "gap"]
    assert sorted((r["alert_id"], r["gap"]) for r in L.feed(rows, need, "alert_id", "alerted_at").collect()) == [("a", 2.0), ("e", 3.0)]
    assert {r["file"]: tuple(r)[1:] for r in L.rejected(rows, need).collect()} == {"one.jsonl": (5, 3, 0), "two.jsonl": (3, 1, 1)}
    assert sorted(r["line"] for r in L.set_aside(rows).collect()) == sorted([*one[3:], two[0]])


QUESTIONS = [
    ("Which 3 hubs have the most friction?", "hub_friction", 3), ("rank warehouses by dwell", "hub_dwell", 5), ("hub with the longest wait", "hub_dwell", 5),
    ("hubs and dwell", None, 5), ("top 50 slowest routes", "corridor_worst", 20), ("0 worst corridors", "corridor_worst", 1), ("FASTEST lane", "corridor_best", 5),
    ("best or worst lanes, 7 of them", "corridor_worst", 7), ("which corridor", None, 5), ("", None, 5), (None, None, 5), ("the 12345 worst lanes", "corridor_worst", 5),
]


def test_questions_choose_their_ranking(spark):
    d = spark.createDataFrame([(k, q) for k, (q, *_) in enumerate(QUESTIONS)], "id int, question string")
    got = {r["id"]: (r["route"], r["n"]) for r in K.routed(d).collect()}
    for k, (q, *want) in enumerate(QUESTIONS):
        assert got[k] == tuple(want), q


def test_answers_are_the_first_rows(spark):
    ranked = spark.createDataFrame([("corridor_best", k, f"c{k}", float(k)) for k in range(1, 21)], "route string, pos int, key string, value double")
    d = spark.createDataFrame([(1, "best 2 lanes"), (2, "worst lanes"), (3, "hello")], "id int, question string")
    got = {r["id"]: r["rows"] and [x["key"] for x in r["rows"]] for r in K.answered(K.routed(d), ranked).collect()}
    assert got == {1: ["c1", "c2"], 2: None, 3: None}


def test_unmatched_alerts_stop_a_table_and_a_stream(spark, tmp_path):
    e = E.build_events(legs_from_events(spark, SF).where("cast(leg_id as int) < 20"))
    facts = e.where("kind = 'fact'")
    whole = E.refusing_unmatched(E.with_finish(e.where("kind = 'query'").select("leg_id"), facts))
    assert whole.count() == 20 and whole.where("od_end_time is null").count() == 0
    short = facts.where("leg_id != '7'")
    with pytest.raises(Exception, match="no finish for leg 7"):
        E.refusing_unmatched(E.with_finish(e.where("kind = 'query'").select("leg_id"), short)).collect()
    J.write_replay(e, str(tmp_path / "in"), 1)
    stream = E.refusing_unmatched(E.with_finish(J.read_files(spark, str(tmp_path / "in")).where("kind = 'query'").select("leg_id"), short))
    with pytest.raises(Exception, match="no finish for leg 7"):
        J.drain(stream, str(tmp_path / "c"), lambda d, i: d.write.mode("append").parquet(str(tmp_path / "o")))


def test_as_of_medians_stand_beside_the_others(spark):
    p = spark.createDataFrame([("1", "plan", 10.0, 0.0), ("1", "mean", 10.0, 4.0), ("2", "plan", 5.0, 0.0), ("2", "mean", 5.0, 1.0)], "leg_id string, model string, gap_min double, predicted double")
    m = spark.createDataFrame([("1", 3, 7.0), ("2", 0, None)], "leg_id string, n long, median double")
    got = sorted(tuple(r) for r in P.as_of_medians(p, m).where("model = 'asof_median'").collect())
    assert got == [("1", "asof_median", 10.0, 7.0), ("2", "asof_median", 5.0, 0.0)]
    assert P.as_of_medians(p, m).where(F.col("model") != "asof_median").count() == 4


def test_snapshots_tell_metrics_from_files(spark):
    from tramline.operators import quality as Q

    metrics = lambda *rows: spark.createDataFrame(list(rows), "metric string, value double, source string")
    files = lambda **hashes: spark.createDataFrame(list(hashes.items()), "file string, sha256 string")
    kept = Q.frozen(metrics(("a", 1.0, "f"), ("b", 2.0, "f"), ("c", 3.0, "g"), ("d", None, "h"), ("e", 5.0, "i")), files(f="1", g="2", h="3", i="4"))
    got = Q.moved_since(kept, metrics(("a", 1.0, "f"), ("b", 2.5, "f"), ("d", None, "h"), ("e", 5.0, "i"), ("x", 9.0, "g")), files(f="1", g="new", h="3"))
    assert sorted(tuple(r)[:3] for r in got.collect()) == [
        ("file", "g", "rewritten"), ("file", "i", "rewritten"), ("metric", "b", "changed"), ("metric", "c", "missing"), ("metric", "e", "unreadable"), ("metric", "x", "added"),
    ]
    assert Q.moved_since(kept, kept.select("metric", "value", "source"), files(f="1", g="2", h="3", i="4")).count() == 0


def test_shipment_rules(spark):
    from tramline.operators import business as B

    orders = spark.createDataFrame([(1, "open"), (2, "cancelled")], "order_id int, status string")
    rows = [("a", 1, 10, 11), ("b", 1, 10, 9), ("c", 2, 10, None), ("d", 3, None, 4), ("e", None, 5, 5)]
    got = {r["shipment_id"]: r["violations"] for r in B.shipment_violations(spark.createDataFrame(rows, "shipment_id string, order_id int, departed_at int, arrived_at int"), orders).collect()}
    assert got == {
        "a": [], "b": ["order has a shipment", "arrives before departure"], "c": ["order cancelled"], "d": ["order unknown"], "e": ["order unknown"],
    }


def test_freshness_of_no_alerts_is_null(spark):
    from tramline.operators import business as B

    d = spark.createDataFrame([("k", "2024-01-01 00:00:00")], "corridor_id string, at string").select("corridor_id", F.col("at").cast("timestamp").alias("alerted_at"))
    now = F.lit("2024-01-01 00:01:30").cast("timestamp")
    assert B.alert_freshness(d, now).first()["age_s"] == 90.0
    assert B.alert_freshness(d.where("false"), now).first()["age_s"] is None


def test_hub_documents_say_what_their_metadata_say(spark):
    from tramline.operators import hubs as U
    from tramline.operators import quality as Q

    got = Q.hub_sentences(U.hub_table(legs_from_events(spark, SF), min_support=5)).collect()
    assert got and all(f"ranks {r['metadata']['friction_rank']} by" in r["text"] and r["metadata"]["hub"] in r["text"] for r in got)
