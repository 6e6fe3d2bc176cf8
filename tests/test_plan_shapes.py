"""Plans keep the shape that large inputs need."""

from __future__ import annotations

import re

from oracle import SF
from pyspark.sql import functions as F

from tramline.operators import audit as A
from tramline.operators import clean as C
from tramline.operators import history as H
from tramline.operators import hubs as U
from tramline.operators import order_statistics as S
from tramline.operators import orders as O
from tramline.operators import quality as Q
from tramline.sources.adapters import legs_from_events, segments_from_lineitem, table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark):
    p = plan(A.network_baseline(legs_from_events(spark, SF)))
    read = re.findall(r"ReadSchema: struct<([^>]*)", p)
    assert read and all("user_id" not in r and "event_type" not in r for r in read)
    p = plan(table(spark, SF, "orders").where("o_orderstatus = 'O'").select("o_orderkey"))
    assert "EqualTo(o_orderstatus,O)" in p and "o_totalprice" not in p


def test_leg_reconstruction_is_one_exchange(spark):
    rows = segments_from_lineitem(spark, SF)
    assert plan(U.reconstruct(rows)).count("Exchange hashpartitioning") == 1  # shared by running totals and legs
    assert plan(A.corridor_aggregate(legs_from_events(spark, SF))).count("SortMergeJoin") == 0


def test_history_has_no_self_join(spark):
    p = plan(H.as_of(legs_from_events(spark, SF), "corridor_id", "x"))
    assert "Join" not in p and p.count("Exchange") == 1 and "Window" in p


def test_features_make_all_histories_in_one_window(spark):
    p = plan(H.features(legs_from_events(spark, SF)))
    assert len(re.findall(r"\bWindow \[", p)) == 1


def test_top_rows_are_taken_per_task(spark):
    p = plan(A.top(table(spark, SF, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5))
    assert "TakeOrderedAndProject" in p
    e = table(spark, SF, "embeddings")
    assert "WindowGroupLimit" in plan(Q.nearest(e, e.where("vec_id % 50 = 0"), 3))


def test_windows_over_all_rows_are_avoided(spark):
    for df in (H.features(legs_from_events(spark, SF)), H.network_prefix(legs_from_events(spark, SF)).select("leg_id")):
        for node in re.findall(r"Exchange SinglePartition.*\n.*", plan(df)):
            assert "HashAggregate" in node or "bucket" in node, node


def test_searches_and_fits_read_written_rows(spark, monkeypatch):
    from tramline.plans import shrinkage, stats, tables

    for module in (stats, shrinkage, tables):
        names: list[str] = []
        real = module.written
        monkeypatch.setattr(module, "written", lambda df, name, names=names, real=real: names.append(name) or real(df, name))
        {stats: stats.eb_reml, shrinkage: shrinkage.ranking_overlap, tables: tables.model_rolling_origin}[module](spark, SF)
        assert len(names) == 1


def test_order_mails_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(O, "MAILS", 10)
    mails = spark.range(200).select(F.col("id").alias("mail_id"), F.lit("s").alias("subject"), F.lit("5 boxes").alias("body")).coalesce(1)
    assert O.read_orders(mails.repartition(8)).rdd.getNumPartitions() == 20


def test_pieces_of_hot_keys_follow_their_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "WHOLE", 50)
    monkeypatch.setattr(S, "PIECE", 20)
    asked = []
    monkeypatch.setattr(S, "_cut_quantiles", lambda d, names, qs, n, ddl, real=S._cut_quantiles: asked.append(n) or real(d, names, qs, n, ddl))
    rows = spark.range(200).select(F.lit("k").alias("k"), F.col("id").alias("t"), (F.col("id") % 2).cast("int").alias("kind"), F.col("id").cast("string").alias("leg_id"), F.col("id").cast("double").alias("g"))
    got = {int(r["leg_id"]): r["m"] for r in S.running_quantiles(rows, "g", {"m": 0.5}, 2).collect()}
    assert asked == [10] and got == {i: (i - 1) / 2 for i in range(1, 200, 2)}


def test_profiles_have_no_task_with_all_values(spark):
    rows = [(None if k % 9 == 0 else float(k * 7919 % 101) / 4, k * 31 % 50 if k % 2 else 2**62 + k, None) for k in range(400)]
    d = spark.createDataFrame(rows, "a double, b bigint, c int")
    df = C.profile(d, ["a", "b", "c"])
    assert "percentile" not in plan(df)
    got = {r["column"]: r for r in df.collect()}
    for c in d.columns:
        want = d.agg(F.count_distinct(c).cast("double").alias("distinct"), F.count_if(F.col(c).isNull()).cast("double").alias("nulls"), *[F.percentile(c, q).alias(n) for n, q in C._QUANTILES.items()]).first()
        assert {n: got[c][n] for n in want.asDict()} == want.asDict()
    assert [r["median"] for r in C.profile(d.limit(0), ["a", "b"]).collect()] == [None, None]
