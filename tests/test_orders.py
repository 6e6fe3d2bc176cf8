"""Order mails, labelled by hand: one behaviour a case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tramline.operators import orders as O

SIGNED = "\n\nBest regards,\nR. Mehta\nLogistics desk, Northern Mills"
ENDS = " from IND110037AAA to IND400093AAB."

WEIGHTS = [
    ("gross weight: 742.5 kg", 742.5), ("total 360 kgs", 360.0), ("it weighs 1.5 tonnes", 1500.0), ("4 MT of yarn", 4000.0), ("2,750 kg on skids", 2750.0),
    ("520 kilograms", 520.0), ("2 t of scrap", 2000.0), ("10 x 20", None), ("t-shirts, 5 sizes", None), ("somewhere between 4 and 5 tonnes", None),
    ("the weight is between 300 and 400 kg", None), ("about 700 kg", None), ("700 kg give or take", None), ("roughly 3 tonnes", None), ("approx. 90 kg or so", None),
    ("300-400 kg", None), ("the weight is 500.0 kg, not 650.0 kg", 500.0), ("0 kg", None), ("weight 640 kg. The dock has it as 655 kg", None),
    ("weight 640 kg, again 640.0 kg", 640.0), ("weight 640 kg or 0.64 tonnes", 640.0), ("about 12 bags, 640 kg", 640.0),
]

PIECES = [
    ("9 pieces", 9), ("no. of packages:     31", 31), ("eleven crates", 11), ("thirty-two boxes", 32), ("forty five units", 45), ("8 pallets on the truck", 8),
    ("roughly 20-24 boxes", None), ("between 6 and 7 cartons", None), ("0 cartons so far", None), ("boxes 90 kg", None), ("bags: 14, 90 kg", 14),
    ("about 14 bags", None), ("2.5 cartons", None), ("two loads", None),
]

ROUTES = [("kindly send an FTL", "FTL"), ("one full truck please", "FTL"), ("carting (part load)", "Carting"), ("part-load will do", "Carting"), ("15 tonnes, 30 pallets", None), ("FTL, no: make it Carting", None)]

COMPANIES = [
    ("Best regards,\nR. Mehta\nLogistics desk, Northern Mills", "Northern Mills"), ("Regards,\nNorthern Mills\nConsignor", "Northern Mills"),
    ("Thanks\n\nShipper,\nBlue Cargo.", "Blue Cargo"), ("Many thanks!\nOps\nsupply chain\nBlue Cargo", "Blue Cargo"), ("Bye\nBlue Cargo", None), ("Regards", None),
    ("Regards,\n> Old Firm", None),
]

#: Mail, outcome, what is asked for.
DECISIONS = [
    ("15 cartons, 480 kg, FTL," + ENDS + SIGNED, "file", None),
    ("15 cartons," + ENDS + SIGNED, "clarify", "weight_kg"),
    ("480 kg, FTL," + ENDS + SIGNED, "clarify", "pieces"),
    ("Pickup at our Pune warehouse, deliver to IND400093AAB. 15 cartons, 480 kg, FTL." + SIGNED, "clarify", "source_center"),
    ("15 cartons, 480 kg, FTL, from IND110037AAA" + SIGNED, "clarify", "destination_center"),
    ("15 cartons, 480 kg, FTL, from IND110037AAA to IND110037AAA" + SIGNED, "clarify", "destination_center"),
    ("15 cartons, 480 kg," + ENDS + SIGNED, "clarify", "route_type"),
    ("15 cartons, 480 kg, FTL," + ENDS, "clarify", "customer_name"),
    ("Three shipments to book. 15 cartons, 480 kg, FTL," + ENDS + SIGNED, "clarify", "consignment"),
    ("1) 15 cartons, 480 kg\n2) 7 cartons, 100 kg\nFTL," + ENDS + SIGNED, "clarify", "consignment"),
    ("1) 15 cartons, 480 kg\nFTL," + ENDS + SIGNED, "file", None),
    ("15 cartons, 480 kg, FTL," + ENDS + SIGNED + "\n> 15 cartons, 610 kg", "file", None),
    ("15 cartons, 480 kg, FTL," + ENDS + SIGNED + "\n--- Forwarded ---\n1) 610 kg\n2) about 700 kg", "file", None),
    ("The weight is 480 kg, not 610 kg. 15 cartons, FTL," + ENDS + SIGNED + "\nOn Monday R. Mehta wrote:\nweight 610 kg", "file", None),
    ("15 cartons, 480 kg, their docket says 610 kg, FTL," + ENDS + SIGNED, "clarify", "weight_kg"),
    ("0 cartons, 480 kg, FTL," + ENDS + SIGNED, "clarify", "pieces"),
    ("", "clarify", "weight_kg"),
]


def read(spark, bodies):
    rows = [(k, b) for k, b in enumerate(bodies)]
    got = O.read_orders(spark.createDataFrame(rows, "mail_id int, body string").withColumn("subject", F.lit(None).cast("string"))).collect()
    return [r for _, r in sorted((r["mail_id"], r) for r in got)]


@pytest.mark.parametrize(("column", "cases"), [("weight_kg", WEIGHTS), ("pieces", PIECES), ("route_type", ROUTES), ("customer_name", COMPANIES)])
def test_fields(spark, column, cases):
    for (text, want), r in zip(cases, read(spark, [t for t, _ in cases]), strict=True):
        assert r[column] == want, text


def test_decisions(spark):
    for (text, outcome, ask), r in zip(DECISIONS, read(spark, [t for t, *_ in DECISIONS]), strict=True):
        assert (r["outcome"], r["ask_for"]) == (outcome, ask), text


def test_ends_go_by_their_cue_not_by_their_order(spark):
    texts = [
        "It has to reach the consignee at Surat, code IND209304AAA. Collection is at our Mysuru premises, code IND560067AAA.",
        "Book from IND560067AAA to IND209304AAA.\n--- Forwarded ---\nfrom IND209304AAA to IND560067AAA",
        "IND560067AAA, IND209304AAA", "IND560067AAA then deliver IND209304AAA", "xIND560067AAA ind560067aaa IND560067AAAB IND560067AAA",
    ]
    got = [(r["source_center"], r["destination_center"]) for r in read(spark, texts)]
    assert got[:4] == [("IND560067AAA", "IND209304AAA")] * 4 and got[4] == ("IND560067AAA", None)


def test_notes_and_quoted_figures(spark):
    texts = ["2 tonnes", "2 tonnes, that is 2000 kg", "weight to follow\n> old: 99 kg, 4 bags"]
    got = read(spark, texts)
    assert [r["notes"] for r in got] == ["weight converted from tonnes", None, None]
    assert (got[2]["weight_kg"], got[2]["pieces"]) == (99.0, 4)


def test_null_mails_and_any_partitions(spark):
    d = spark.createDataFrame([(1, None, None), (2, "15 cartons, 480 kg", None)], "mail_id int, subject string, body string")
    one, many = (sorted(map(tuple, O.read_orders(d.repartition(n)).collect())) for n in (1, 7))
    assert one == many and len(one) == 2
