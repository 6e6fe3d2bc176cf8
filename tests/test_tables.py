from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from oracle import SF, connection
from pyspark.sql import functions as F

from tramline.functions.columns import rounded_cents
from tramline.functions.rank import average_rank
from tramline.operators import business as B
from tramline.operators import clean as C
from tramline.operators import hubs as U
from tramline.operators import models as M
from tramline.operators import orders as O
from tramline.operators import quality as Q
from tramline.operators import statistics as T
from tramline.plans import tables as P
from tramline.queries import ORACLE_SQL
from tramline.sources import files as S


def test_clean_dirty_segments(spark):
    cols = "source_row_index long, trip_uuid string, source_center string, destination_center string, source_name string, destination_name string, od_start_time string, od_end_time string, is_cutoff string, osrm_time double, actual_time double, segment_actual_time double, segment_osrm_time double"
    ok = ("t1", " ind282002aad", "IND388121AAA", "nan", "Anand_VU_DC (Gujarat)", "2024-01-01 10:00:00", "2024-01-01 12:00:00.500000", "True", 10.0, 20.0, 5.0, 4.0)
    rows = [(0, *ok), (1, *ok), (2, "t2", "IND282002AAD", "IND388121AAA", "Agra_X_H (Uttar Pradesh)", "N/A", "2024-01-01 10:00:00", "2024-01-01 09:00:00", "false", 10.0, 20.0, 5.0, 4.0),
            (3, "-", "IND282002AAD", "IND388121AAA", "-", "-", "soon", "2024-01-01 12:00:00", "false", 0.0, 20.0, -1.0, 0.0)]
    raw = spark.createDataFrame(rows, cols)
    got = [r.asDict() for r in C.clean(raw, ["od_start_time", "od_end_time"]).collect()]
    assert len(got) == 1
    r = got[0]
    assert r["source_row_index"] == 0 and r["source_center"] == "IND282002AAD" and r["source_name"] == "Agra_X_H (Uttar Pradesh)"
    assert r["dest_city"] == "Anand" and r["dest_state"] == "Gujarat" and r["od_duration_min"] == pytest.approx(120 + 0.5 / 60) and r["is_cutoff"]
    counts = C.drop_counts(C.cast_types(C.nulls_from_text(raw), ["od_start_time", "od_end_time"])).first()
    assert (counts["null_trip_uuid"], counts["inverted_od_window"], counts["unparseable_od_window"], counts["nonpositive_osrm_time"], counts["kept"]) == (1, 1, 1, 1, 2)


def test_contract(spark):
    c = C.Contract("t", 2, {"a": "bigint", "b": "string"}, ["a"])
    d = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "a long, b string")
    r = c.verify(d).first()
    assert (r["rows"], r["repeated_keys"], r["null_keys"], r["breaches"]) == (3, 1, 1, [])
    assert c.breaches(d.withColumn("e", F.lit(1)).drop("b")) == ["missing b", "extra e"]
    assert c.repaired(d.drop("b")).columns == ["a", "b"]
    with pytest.raises(ValueError):
        C.guard_outcomes(d.withColumn("actual_time", F.lit(1)))


def test_csv_with_pinned_schema(spark, tmp_path):
    cols = {"a": "int", "b": "string"}
    (tmp_path / "x.csv").write_text("a,b\n1,x\nq,y\n")
    d = S.read_pinned_csv(spark, str(tmp_path / "x.csv"), cols).cache()
    assert d.where("_corrupt_record is not null").count() == 1
    (tmp_path / "y.csv").write_text("a,c\n1,x\n")
    with pytest.raises(ValueError, match="columns changed"):
        S.read_pinned_csv(spark, str(tmp_path / "y.csv"), cols)


def test_row_index_fingerprint_and_logs(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(50).repartition(3).write.parquet(p)
    d = S.with_row_index(spark.read.parquet(p))
    assert sorted(r[0] for r in d.select("source_row_index").collect()) == list(range(50))
    assert S.fingerprint(spark, p + "/*.parquet").count() == 3
    S.write_partitioned(spark.range(4).withColumn("p", F.col("id") % 2), str(tmp_path / "q"), "p")
    assert (tmp_path / "q" / "p=0").exists()
    S.export_csv(spark.range(3), str(tmp_path / "c"), "id")
    S.write_lookup(spark.range(3), str(tmp_path / "l"))
    assert S.shape(spark.read.parquet(str(tmp_path / "l"))).first()["rows"] == 3
    (tmp_path / "log.json").write_text('{"t": 1, "agent": "a"}\nbroken\n{"t": 3, "agent": "a"}\n{"t": 2, "agent": "b"}\n')
    got = [r["t"] for r in S.read_json_log(spark, str(tmp_path / "log.json"), "t int, agent string", "t", 5, agent="a").collect()]
    assert got == [3, 1]


_ENDS, _SIGNED = ", from IND282002AAD to IND388121AAA", "\nBest regards,\nMeera\nLogistics"


_MAILS = [
    ("move 12 cartons, weight 1,500 kg, Carting" + _ENDS + _SIGNED, ("file", None, 1500.0, 12)),
    ("move 12 cartons, about 1500 kg, Carting" + _ENDS + _SIGNED, ("clarify", "weight_kg", None, 12)),
    ("move 10-12 cartons, 2 tonnes, full truck" + _ENDS + _SIGNED, ("clarify", "pieces", 2000.0, None)),
    ("12 cartons, 90 kg, not 80 kg, part load" + _ENDS + _SIGNED, ("file", None, 90.0, 12)),
    ("12 cartons, 90 kg or 80 kg, part load" + _ENDS + _SIGNED, ("clarify", "weight_kg", None, 12)),
    ("12 cartons, 90 kg" + _ENDS + _SIGNED + "\n> FTL, 70 kg", ("file", None, 90.0, 12)),
    ("> 70 kg\n12 cartons, 2 t, ftl" + _ENDS + _SIGNED, ("file", None, 2000.0, 12)),
    ("12 cartons, 90 kg" + _ENDS + _SIGNED, ("clarify", "route_type", 90.0, 12)),
    ("12 cartons, 90 kg, ftl" + _ENDS, ("clarify", "customer_name", 90.0, 12)),
    ("twenty-five pallets, 90 kg, ftl" + _ENDS + _SIGNED, ("file", None, 90.0, 25)),
    ("No. of packages: 7, 90 kg, ftl" + _ENDS + _SIGNED, ("file", None, 90.0, 7)),
    ("0 bags, 90 kg, ftl" + _ENDS + _SIGNED, ("clarify", "pieces", 90.0, None)),
    ("two loads of 12 cartons, 90 kg, ftl" + _ENDS + _SIGNED, ("clarify", "consignment", 90.0, 12)),
    ("1) 12 cartons\n2) 9 cartons, 90 kg, ftl" + _ENDS + _SIGNED, ("clarify", "consignment", 90.0, 12)),
    ("12 units, somewhere between 2 and 3 tonnes, ftl" + _ENDS + _SIGNED, ("clarify", "weight_kg", None, 12)),
    ("12 cases, 90 kg, ftl, from IND282002AAD to IND282002AAD" + _SIGNED, ("clarify", "destination_center", 90.0, 12)),
    ("nothing", ("clarify", "weight_kg", None, None)),
    (None, ("clarify", "weight_kg", None, None)),
]


def test_order_mails(spark):
    mails = spark.createDataFrame([(i, "Order", body) for i, (body, _) in enumerate(_MAILS)], "mail_id int, subject string, body string")
    got = {r["mail_id"]: (r["outcome"], r["ask_for"], r["weight_kg"], r["pieces"]) for r in O.read_orders(mails).collect()}
    for i, (body, want) in enumerate(_MAILS):
        assert got[i] == want, body


def test_order_ends_and_company(spark):
    rows = [
        (1, "Deliver to our depot IND388121AAA please. The pickup is at IND282002AAD.\nRegards,\nLogistics desk, Acme Traders"),
        (2, "IND282002AAD, IND388121AAA\nThanks\n\nShipper,\nBlue Cargo."),
        (3, "consignee IND388121AAA" + " x" * 60 + " IND282002AAD\nRegards"),
    ]
    got = {r["mail_id"]: (r["source_center"], r["destination_center"], r["customer_name"]) for r in O.read_orders(spark.createDataFrame(rows, "mail_id int, body string").withColumn("subject", F.lit(""))).collect()}
    ends = ("IND282002AAD", "IND388121AAA")
    assert got == {1: (*ends, "Acme Traders"), 2: (*ends, "Blue Cargo"), 3: (*ends, None)}


def test_invoice_rules(spark):
    cols = "invoice_id int, invoice_number string, received_at int, corridor_id string, route_type string, weight_kg double, freight_charge double, other_charges double, total_amount double, currency string"
    rows = [(1, "a", 1, "k", "FTL", 100.0, 3500.0, 350.0, 3850.0, "INR"), (2, "a", 2, "k", "FTL", 100.0, 9000.0, 900.0, 9901.0, "USD"), (3, "b", 3, "none", "FTL", 100.0, 9000.0, 900.0, 9900.0, "INR")]
    km = spark.createDataFrame([("k", 100.0)], "corridor_id string, corridor_km double")
    got = {r["invoice_id"]: (r["findings"], r["verdict"]) for r in B.audit_invoices(spark.createDataFrame(rows, cols), km).collect()}
    assert got[1] == ([], "approve") and got[3] == ([], "approve")
    assert got[2] == (["total_mismatch", "rate_above_band", "duplicate_invoice_number", "unexpected_currency"], "dispute")


def test_sections_fold_short_ones_forward(spark):
    d = spark.createDataFrame([(1, "# A\nshort\n## B\n" + "x" * 300 + "\n## C\nend")], "doc_id int, text string")
    got = [r["text"][:5] for r in Q.sections(d).orderBy("section").collect()]
    assert got == ["# A\ns", "## C\n"]


def test_spread_sample(spark):
    got = [r["id"] for r in Q.spread_sample(spark.range(10), [F.col("id")], 3).orderBy("id").collect()]
    assert len(got) == 3 and got[-1] == 9


def test_last_row_of_running_totals(spark):
    d = spark.createDataFrame([("l", 1, "FTL", 5.0, 4.0, 5.0, 4.0), ("l", 2, "FTL", -1.0, 3.0, 4.0, 7.0)], "leg string, row_index int, route_type string, segment_actual_time double, segment_osrm_time double, actual_time double, osrm_time double")
    assert U.reconstruct(d).first()["actual_time"] == 4.0
    assert U.first_maximum(d).first()["row_index"] == 1


def connection_of(path):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{path}/events.parquet/*.parquet')")
    return con


def test_cents_are_rounded_as_sql_does(spark):
    d = spark.createDataFrame([(2421.575,), (2529.055,), (0.125,), (-0.125,)], "x double")
    got = [r[0] for r in d.select(rounded_cents(F.col("x"))).collect()]
    con = connection()
    assert got == [con.execute(f"select round(CAST({x} AS DOUBLE), 2)").fetchone()[0] for (x,) in d.collect()] == [2421.57, 2529.05, 0.13, -0.13]


def test_invoice_charges_of_half_a_cent(spark, tmp_path):
    o = spark.createDataFrame([(113644, 1, "F", 252905.5, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    o.withColumn("o_orderdate", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i,) for i in range(25)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    assert "other_charges_out_of_band" in P.invoices_audited(spark, str(tmp_path)).first()["findings"]


def test_a_threshold_is_taken_as_written(spark):
    d = spark.createDataFrame([(11.0, 3.3000000000000007), (10.0, 3.0)], "planned_min double, predicted_gap double")
    assert [r["planned_min"] for r in B.flag_alerts(d, 1.3).collect()] == [11.0]


def test_no_alerts_no_quality(spark):
    rows = spark.createDataFrame([("a", "k", 10.0, 9.0, False), ("b", "k", 10.0, 1.0, False)], "leg_id string, corridor_id string, planned_min double, gap_min double, is_delayed boolean")
    mean = lambda x: rows.select("leg_id", F.lit(x).alias("predicted_gap"))
    assert [r["history"] for r in B.replay_leak(rows, mean(5.0), mean(1.0), 1.3).collect()] == ["as of creation"]


def test_alerts_of_tables_without_any(spark, tmp_path):
    e = spark.createDataFrame([(1, 3, "view", 1.0, '{"k": 76}')], "event_id long, user_id long, event_type string, value double, props string")
    e.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert tuple(P.alerts_same(spark, str(tmp_path)).first()) == (None, None, 0, 0.5) == connection_of(tmp_path).execute(ORACLE_SQL["alerts_same"]).fetchone()


def test_histogram_bounds_as_in_its_sql(spark):
    values = [k / 5 for k in range(26)] + [0.6000000000000001, 4.999999999999, -1.0, 7.0]
    got = {r["bin"]: r["n"] for r in C.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", 0.0, 5.0, 25).collect()}
    want = connection().execute(f"select bin, count(*) from (select least(25, greatest(1, CAST(floor(least(greatest(v, 0), 5) / 0.2) AS BIGINT) + 1)) AS bin from (select unnest({values}::DOUBLE[]) v)) group by 1").fetchall()
    assert {b: n for b, n in got.items() if n} == dict(want) and len(got) == 25


def test_ranks_of_values_that_differ_when_computed_again(spark):
    noisy = F.udf(lambda i: float(i) + random.random() / 2, "double").asNondeterministic()  # as sums in another order, but coarser
    d = spark.range(200).select("id", noisy("id").alias("v"))
    assert average_rank(d, "v").count() == 200


def test_persistence_without_slow_corridors(spark):
    d = spark.createDataFrame([(p, c, False) for p in (1, 2) for c in "xy"], "part int, corridor_id string, slow boolean")
    r = T.part_overlap(d).first()
    assert r["low"] != r["low"] and r["high"] == 1.0 and r["jaccard"] is None and r["common"] == 2


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    """Against the plain definition over all pairs: copies, other lengths, nulls and repeated ids, in several blocks."""
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)], k % 3) for k in range(120)] + [(200 + k, [1.0, 2.0, 3.0, 4.0], 1) for k in range(30)]
    rows += [(300, None, 1), (301, [1.0, None, 2.0, 1.0], 1), (302, [1.0, 2.0], 1), (303, [2.0, 1.0], 1), (None, [1.0, 1.0, 1.0, 1.0], 1), (200, [1.0, 2.0, 3.0, 4.5], None)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(Q, "QUERY_BLOCK", 20)
    monkeypatch.setattr(Q, "BASE_BLOCK", 40)
    monkeypatch.setattr(Q, "_TILE", 7)
    queries = e.where("vec_id % 5 = 0 or vec_id > 299")

    def plain(k, least=None, same=False):
        f = [np.array(r[1], dtype="float32").astype(float) if r[1] and None not in r[1] else None for r in rows]
        unit = [None if v is None else v / math.sqrt(sum(float(x) * float(x) for x in v)) for v in f]
        out = []
        for i, (a, _, la) in enumerate(rows):
            if a is not None and (a % 5 == 0 or a > 299):
                for j, (b, _, lb) in enumerate(rows):
                    if b is not None and a != b and (not same or (la is not None and la == lb)):
                        s = round(sum(unit[i] * unit[j]), 9) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) else None
                        if least is None or (s is not None and s >= least):
                            out.append((a, b, s))
        best = {}
        for a, b, s in sorted(out, key=lambda r: (r[2] is None, -(r[2] or 0), r[1])):
            best.setdefault(a, []).append((b, s))
        return {(a, b, s, n + 1) for a, r in best.items() for n, (b, s) in enumerate(r[:k])}

    for args in ({"k": 3}, {"k": 200}, {"k": 2, "least": 0.1}, {"k": 4, "same": True}):
        df = Q.nearest(e, queries, args["k"], args.get("least"), "label" if args.get("same") else None)
        assert {tuple(r) for r in df.collect()} == plain(**args), args
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_time_split_takes_its_quantile_once(spark, monkeypatch):
    monkeypatch.setattr(M, "SPANS", 100)
    rng = random.Random(2)
    start = 1_700_000_000_000_000
    cases = [[start], [start] * 7, [start, start + 1], [-5, -3, 4], [start + rng.randrange(60) for _ in range(200)], [rng.randrange(-(10**15), 10**15) for _ in range(101)]]
    for times in cases:
        rows = spark.createDataFrame([(t,) for t in [*times, None]], "t long").select(F.expr("cast(timestamp_micros(t) as timestamp_ntz)").alias("trip_creation_time"), "t")
        for share in (0.33, 1.0):
            want = rows.agg(F.percentile("t", share)).first()[0]
            assert M.time_cut(rows, share) == want
            split = M.time_split(rows, share)
            assert all((r["part"] == "train") == (r["t"] is not None and r["t"] <= want) for r in split.select("t", "part").collect())
            p = split._jdf.queryExecution().executedPlan().toString()
            assert "percentile" not in p and "Join" not in p
    assert M.time_cut(rows.where("t is null"), 0.8) is None and M.time_split(rows.where("t is null")).select("part").first()[0] == "test"


def test_training_rows_have_only_what_fits_read(spark, monkeypatch):
    names = []
    monkeypatch.setattr(P, "written", lambda df, name: names.append(df) or df)
    P._training(spark, SF)
    assert set(names[0].columns) == {"leg_id", "trip_creation_time", "gap_min", "is_delayed", *M.INPUTS}
    # Base rows and histories: creation times come with the base, not by a reading and an exchange of their own.
    assert names[0]._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 2


def test_folds_have_only_what_a_forest_reads(spark, monkeypatch):
    rows = spark.range(60).select(F.col("id").cast("string").alias("leg_id"), F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("gap_min"))
    folds = []
    monkeypatch.setattr(M.CrossValidator, "fit", lambda cv, df, real=M.CrossValidator.fit: folds.append(df.columns) or real(cv, df))
    model = M.tuned(rows, "rf", 2, ["x"])
    assert folds == [["features", "gap_min"]]
    assert M.importances(model, ["x"]) == [("x", 1.0)] and M.score(model, rows).count() == 60
