"""Order mails: what they ask for, what is missing, what is wrong, and how well the reading agrees with the truth.

A mail is cut into tokens once: codes, numbers, words and dashes, each with its meaning and whether its line is quoted.  Every field
is then decided by a token's neighbours in the array, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words in which orders are written, by meaning.
_WORDS = {
    "kg": ["kg", "kgs", "kilo", "kilos", "kilogram", "kilograms"],
    "tonne": ["t", "mt", "ton", "tons", "tonne", "tonnes"],
    "piece": [
        "piece", "pieces", "pcs", "package", "packages", "carton", "cartons", "crate", "crates", "box", "boxes", "pallet", "pallets", "bag", "bags", "unit",
        "units", "case", "cases",
    ],
    "hedge": ["about", "around", "roughly", "approx", "approximately", "circa", "~", "estimated", "est", "maybe", "upto"],
    "from": [
        "pickup", "pick", "collect", "collected", "collection", "origin", "source", "from", "ex", "premises", "warehouse", "loading", "despatch", "despatched",
        "dispatch", "dispatched",
    ],
    "to": ["deliver", "delivered", "delivery", "dest", "destination", "to", "reach", "receiver", "consignee", "depot", "unloading", "drop"],
}
_SPELLED = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30,
    "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
_JOINERS = ["-", "–", "—", "to", "and"]
_SEVERAL, _BOOKINGS = ["two", "three", "both"], ["loads", "shipments", "consignments", "bookings", "orders"]
_SIGN_OFFS = ["regards", "best regards", "kind regards", "thanks", "many thanks", "thank you", "sincerely", "cheers"]
_DESKS = ["desk", "department", "team", "division"]
_ROLES = ["consignor", "consignee", "shipper", "logistics", "logistics desk", "operations", "ops", "supply chain", "dispatch", "despatch"]
_FORWARDED = ["--- forwarded", "wrote:", "original message"]
_CODE = r"IND\d{6}[A-Z]{3}"
#: Fields in the order in which they are asked for.
ASKED = ["consignment", "weight_kg", "pieces", "source_center", "destination_center", "route_type", "customer_name"]

#: A code, a number, a word or a sign that joins or hedges.
_TOKEN = rf"({_CODE}(?![A-Za-z0-9_])|\d[\d,]*(?:\.\d+)?|[A-Za-z]+|[~–—-])"
#: Tokens after which a cue no longer speaks of a code, and lines under a sign-off that may name the company.
_REACH, _TAIL = 20, 4
#: Mails that one task reads.
MAILS = 20_000


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _lines(text: Column) -> Column:
    """Lines with whether they are quoted: marked by ">", or from a forwarding header on."""
    lines = F.split(text, r"\R")
    header = lambda s: F.lower(s).rlike("|".join(_FORWARDED))
    fold = F.aggregate(
        lines, F.struct(F.lit(False).alias("below"), F.array().cast("array<struct<text:string,quoted:boolean>>").alias("out")),
        lambda s, x: F.struct(
            (s["below"] | header(x)).alias("below"),
            F.array_append(s["out"], F.struct(F.trim(x).alias("text"), (s["below"] | header(x) | F.trim(x).startswith(">")).alias("quoted"))).alias("out"),
        ),
    )
    return fold["out"]


def _tokens(lines: Column) -> Column:
    """Tokens (w in lower case but for codes, kind, num, quoted) of all lines."""

    def token(w: Column, quoted: Column) -> Column:
        low = F.lower(w)
        kind = F.when(w.rlike(rf"^{_CODE}$"), "code").when(w.rlike(r"^\d"), "num").when(low.isin(list(_SPELLED)), "spelled")
        for name, words in _WORDS.items():
            kind = kind.when(low.isin(words), name)
        num = F.regexp_replace(w, ",", "").try_cast("double")
        return F.struct(F.when(kind == "code", w).otherwise(low).alias("w"), kind.otherwise("word").alias("kind"), num.alias("num"), quoted.alias("quoted"))

    cut = F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x["text"], F.lit(_TOKEN)), lambda w: token(w, x["quoted"])))
    return F.flatten(cut)


class _Around:
    """The neighbours of the i-th token of an array column."""

    def __init__(self, tokens: str, i: Column):
        self.at = lambda k: F.get(F.col(tokens), i + k)
        self.kind = lambda k: F.coalesce(self.at(k)["kind"], F.lit(""))
        self.word = lambda k: F.coalesce(self.at(k)["w"], F.lit(""))

    def hedged(self) -> Column:
        """A hedge stands before the figure with at most two plain words between them, or after it and its noun."""
        plain = lambda k: self.kind(-k) == "word"
        before = (self.kind(-1) == "hedge") | (plain(1) & (self.kind(-2) == "hedge")) | (plain(1) & plain(2) & (self.kind(-3) == "hedge"))
        after = ((self.word(2) == "or") & (self.word(3) == "so")) | ((self.word(2) == "give") & (self.word(4) == "take"))
        return before | after

    def ranged(self) -> Column:
        """The figure ends a range: another figure and a joining word stand before it, or "between" does."""
        joined = self.word(-1).isin(_JOINERS) & self.kind(-2).isin("num", "spelled")
        return joined | (self.word(-1) == "between") | (self.word(-3) == "between")


def _weight_mentions(tokens: str) -> Column:
    """Figures with a unit of weight, but those that "not" takes back: kilograms, whether vague, quoted or in tonnes."""

    def mention(t: Column, i: Column) -> Column:
        near = _Around(tokens, i)
        is_weight = (t["kind"] == "num") & near.kind(1).isin("kg", "tonne") & (near.word(-1) != "not")
        kg = t["num"] * F.when(near.kind(1) == "tonne", 1000.0).otherwise(1.0)
        fields = [kg.alias("kg"), (near.hedged() | near.ranged() | (kg <= 0)).alias("vague"), t["quoted"].alias("quoted"), (near.kind(1) == "tonne").alias("tonnes")]
        return F.when(is_weight, F.struct(*fields))

    return F.array_compact(F.transform(F.col(tokens), mention))


def _count_mentions(tokens: str) -> Column:
    """Counts of pieces with their rank: before their noun, after it (a weight after it is none), spelled; whether vague, quoted."""
    value = F.create_map(*[F.lit(x) for pair in _SPELLED.items() for x in pair])

    def mention(t: Column, i: Column) -> Column:
        near = _Around(tokens, i)
        whole = lambda k: (near.kind(k) == "num") & (near.at(k)["num"] == F.floor(near.at(k)["num"])) & ~near.kind(k + 1).isin("kg", "tonne", "piece")
        form = lambda rank, n, vague: F.struct(F.lit(rank).alias("rank"), n.cast("long").alias("n"), vague.alias("vague"), t["quoted"].alias("quoted"))
        vague = near.hedged() | near.ranged()
        # Tens and ones, joined or not, are one number; its second word counts nothing by itself.
        worth = lambda k: F.coalesce(F.try_element_at(value, near.word(k)), F.lit(0))
        pair = lambda a, b: (worth(a) >= 20) & worth(b).between(1, 9)
        tens = F.when((near.word(1) == "-") & pair(0, 2) & (near.kind(3) == "piece"), near.word(2)).when(pair(0, 1) & (near.kind(2) == "piece"), near.word(1))
        second = ((near.word(-1) == "-") & pair(-2, 0)) | pair(-1, 0)
        spoken = F.try_element_at(value, t["w"]) + F.coalesce(F.try_element_at(value, tens), F.lit(0))
        behind = F.coalesce(*[F.when(whole(k), near.at(k)["num"]) for k in (1, 2, 3)])
        return (
            F.when((t["kind"] == "num") & (near.kind(1) == "piece") & (t["num"] == F.floor(t["num"])), form(1, t["num"], vague))
            .when((t["kind"] == "piece") & behind.isNotNull(), form(2, behind, F.lit(False)))
            .when((t["kind"] == "spelled") & ~second & ((near.kind(1) == "piece") | tens.isNotNull()), form(3, spoken, vague))
        )

    return F.array_compact(F.transform(F.col(tokens), mention))


def _live(mentions: Column) -> Column:
    """Mentions outside quoted lines; all, if there are none outside."""
    live = F.filter(mentions, lambda x: ~x["quoted"])
    return F.when(F.size(live) > 0, live).otherwise(mentions)


def _ends(tokens: Column) -> Column:
    """Codes in order and those said to be the two ends: by the last cue since the code before."""
    begin = F.struct(
        F.lit("").alias("cue"), F.lit(0).alias("age"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("destination"),
        F.array().cast("array<string>").alias("codes"),
    )

    def step(s: Column, t: Column) -> Column:
        code, cue = t["kind"] == "code", t["kind"].isin("from", "to")
        said = lambda end, to: F.when(code & (s["cue"] == to) & (s["age"] <= _REACH) & s[end].isNull(), t["w"]).otherwise(s[end]).alias(end)
        return F.struct(
            F.when(cue, t["kind"]).when(code, "").otherwise(s["cue"]).alias("cue"), F.when(cue, 1).otherwise(s["age"] + 1).alias("age"), said("source", "from"),
            said("destination", "to"), F.when(code & ~F.array_contains(s["codes"], t["w"]), F.array_append(s["codes"], t["w"])).otherwise(s["codes"]).alias("codes"),
        )

    return F.aggregate(tokens, begin, step)


def _company(lines: Column) -> Column:
    """The company in the lines under a sign-off: what follows "... desk,", else the first line that is not a mere role."""
    texts = F.transform(lines, lambda x: F.when(x["quoted"], "").otherwise(x["text"]))
    closes = lambda s: F.trim(F.lower(F.regexp_replace(s, "[^A-Za-z ]", ""))).isin(_SIGN_OFFS)
    tails = F.array_compact(F.transform(texts, lambda s, i: F.when(closes(s), F.filter(F.slice(texts, i + 2, F.lit(_TAIL)), lambda x: x != ""))))

    def named(tail: Column) -> Column:
        unit = lambda x: F.element_at(F.split(F.trim(F.lower(F.substring_index(x, ",", 1))), r"\s+"), -1)
        desk = F.filter(tail, lambda x: x.contains(",") & unit(x).isin(_DESKS))
        after = F.transform(desk, lambda x: F.trim(F.substr(x, F.instr(x, ",") + 1)))
        bare = F.transform(tail, lambda x: F.btrim(x, F.lit(" ,.")))
        return F.coalesce(_first(F.filter(after, lambda x: x != "")), _first(F.filter(bare, lambda x: ~F.lower(x).isin(_ROLES) & (x != ""))))

    return F.nullif(_first(F.array_compact(F.transform(tails, named))), F.lit(""))


def _consignments(tokens: str, lines: Column) -> Column:
    """How many orders a mail says that it holds: two for "two loads" and the like, else its numbered lines, else one."""

    def several(t: Column, i: Column) -> Column:
        return t["w"].isin(_SEVERAL) & _Around(tokens, i).word(1).isin(_BOOKINGS)

    sign = lambda x, k: F.substr(x["text"], F.lit(k), F.lit(1))
    listed = F.filter(lines, lambda x: ~x["quoted"] & sign(x, 1).between("1", "9") & sign(x, 2).isin(")", ".") & (sign(x, 3) == " "))
    numbers = F.array_distinct(F.transform(listed, lambda x: sign(x, 1)))
    said = F.exists(F.transform(F.col(tokens), several), lambda x: x)
    return F.when(said, 2).otherwise(F.greatest(F.lit(1), F.size(numbers)))


def _spread(mails: DataFrame) -> DataFrame:
    """Tasks of at most about MAILS mails, and one for each core at least: a small file is one task, and a large one has few."""
    n = max(mails.sparkSession.sparkContext.defaultParallelism, -(-mails.count() // MAILS))
    return mails.repartition(n)


def read_orders(mails: DataFrame) -> DataFrame:
    """Fields of order mails (mail_id, subject, body), and what is missing.

    A field that is given as a range or an estimate counts as missing, and so do both route types at once and equal ends.
    Weights and counts in quoted lines ("> ...", or under a forwarding header) contradict nothing and count only where the mail has no
    other.  Two weights of the mail itself that differ are none; one after "not" is taken back.  A code belongs to the end
    whose cue is the last since the code before; an end without a cue takes the next unused code.  A mail of several
    consignments is never filed.  The first missing field in the order of ASKED is asked for; otherwise the order is filed.
    A null subject or body counts as empty.
    """
    # Each step names what the next one uses more than once.
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = _spread(mails.select("mail_id", F.concat_ws("\n", empty("subject"), empty("body")).alias("_text")))
    d = d.withColumn("_lines", _lines(F.col("_text"))).withColumn("_t", _tokens(F.col("_lines")))
    words = F.concat(F.lit(" "), F.array_join(F.transform("_t", lambda t: t["w"]), " "), F.lit(" "))
    d = d.withColumns({"_all": _weight_mentions("_t"), "_counts": _count_mentions("_t"), "_ends": _ends(F.col("_t")), "_words": words})
    said = lambda *phrases: F.greatest(*[F.col("_words").contains(f" {p} ") for p in phrases], F.lit(False))
    ftl, carting = said("ftl", "full truck"), said("carting", "part load", "part - load")
    d = d.withColumns({"_w": _live(F.col("_all")), "_c": _live(F.col("_counts")), "_n": _consignments("_t", F.col("_lines"))})
    live = F.filter("_w", lambda x: ~x["quoted"])
    differ = F.size(F.array_distinct(F.transform(live, lambda x: F.round(x["kg"], 1)))) > 1
    vague = F.exists("_w", lambda x: x["vague"]) | differ
    kg = F.when(~vague, F.round(_first(F.col("_w"))["kg"], 3))
    counts = F.array_sort(F.transform("_c", lambda x, i: F.struct(x["rank"].alias("rank"), i.alias("i"), x["n"].alias("n"), x["vague"].alias("vague"))))
    count = _first(counts)
    pieces = F.when(~F.exists("_c", lambda x: x["vague"]) & (count["n"] >= 1), count["n"])
    source, destination = F.col("_ends.source"), F.col("_ends.destination")
    rest = F.filter("_ends.codes", lambda c: F.coalesce(c != source, F.lit(True)) & F.coalesce(c != destination, F.lit(True)))
    d = d.withColumn("_rest", rest).withColumn("_kg", kg)
    tonnes_only = F.exists("_all", lambda x: x["tonnes"]) & ~F.exists("_all", lambda x: ~x["tonnes"])
    d = d.select(
        "mail_id", F.coalesce(source, _first(F.col("_rest"))).alias("source_center"),
        # Equal ends are said with one code twice; the second cue then has it too.
        F.coalesce(destination, F.get("_rest", F.when(source.isNull(), 1).otherwise(0))).alias("destination_center"),
        F.when(ftl & ~carting, "FTL").when(carting & ~ftl, "Carting").alias("route_type"), F.col("_kg").alias("weight_kg"), pieces.alias("pieces"),
        _company(F.col("_lines")).alias("customer_name"), F.col("_n").alias("consignments"),
        F.when(F.col("_kg").isNotNull() & tonnes_only, "weight converted from tonnes").alias("notes"),
    )
    gone = {c: F.col(c).isNull() for c in ASKED if c != "consignment"} | {"consignment": F.col("consignments") > 1}
    gone["destination_center"] |= F.coalesce(F.col("source_center") == F.col("destination_center"), F.lit(False))
    ask = F.coalesce(*[F.when(gone[c], F.lit(c)) for c in ASKED])
    return d.withColumn("ask_for", ask).withColumn("outcome", F.when(F.col("ask_for").isNull(), "file").otherwise("clarify"))


def order_problems(orders: DataFrame, centres: DataFrame) -> DataFrame:
    """Problems of read orders: missing fields, codes of a wrong form or unknown, equal ends, weights and counts out of bounds."""
    known = lambda c: centres.select(F.col("centre_code").alias(c), F.lit(1).alias(f"_{c}")).distinct()
    d = orders.join(known("source_center"), "source_center", "left").join(known("destination_center"), "destination_center", "left")
    source, destination = F.col("source_center"), F.col("destination_center")
    rules = [(f"missing {c}", F.col(c).isNull()) for c in ASKED if c != "consignment"] + [
        ("malformed source", ~source.rlike(rf"^{_CODE}\b")), ("malformed destination", ~destination.rlike(rf"^{_CODE}\b")),
        ("unknown source", source.isNotNull() & F.col("_source_center").isNull()),
        ("unknown destination", destination.isNotNull() & F.col("_destination_center").isNull()),
        ("same ends", source == destination), ("unknown route type", ~F.col("route_type").isin("FTL", "Carting")),
        ("weight out of bounds", ~F.col("weight_kg").between(0.001, 40_000)), ("pieces out of bounds", F.col("pieces") < 1),
    ]
    problems = F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules]))
    return d.withColumn("problems", problems).drop("_source_center", "_destination_center")


def score_orders(read: DataFrame, truth: DataFrame) -> DataFrame:
    """Per mail of ``truth`` (mail_id, kind, want_outcome, want_ask and want_<field>, null where nothing is expected): what was right.

    A weight may differ by 1 kg or half a percent, texts by case and outer blanks.  An order to file succeeds if it was
    filed with every expected field; one to clarify, if the right field was asked for.  A mail that wasn't read has no outcome.
    """
    fields = [c for c in ASKED if f"want_{c}" in truth.columns]
    d = truth.join(read.select("mail_id", "outcome", "ask_for", *fields), "mail_id", "left")

    def wrong(c: str) -> Column:
        got, want = F.col(c), F.col(f"want_{c}")
        if c == "weight_kg":
            agrees = F.abs(got - want) <= F.greatest(F.lit(1.0), 0.005 * want)
        elif c == "pieces":
            agrees = got == want
        else:
            agrees = F.upper(F.trim(got)) == F.upper(F.trim(want))
        return F.when(want.isNotNull() & ~F.coalesce(agrees, F.lit(False)), F.lit(c))

    filed, asked = F.coalesce(F.col("outcome") == "file", F.lit(False)), F.coalesce(F.col("outcome") == "clarify", F.lit(False))
    to_file = F.col("want_outcome") == "file"
    d = d.withColumn("mismatched", F.when(to_file, F.array_compact(F.array(*[wrong(c) for c in fields]))).otherwise(F.expr("cast(array() as array<string>)")))
    right_field = asked & F.coalesce(F.col("ask_for") == F.col("want_ask"), F.lit(False))
    return d.select(
        "mail_id", "kind", "want_outcome", "outcome", "mismatched", F.coalesce(F.col("outcome") == F.col("want_outcome"), F.lit(False)).alias("outcome_right"),
        (~to_file & filed).alias("invented"), (to_file & asked).alias("needless"), F.col("outcome").isNull().alias("failed"),
        F.when(to_file, filed & (F.size("mismatched") == 0)).otherwise(right_field).alias("success"),
    )


def order_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Rates of scored mails per group; null where a rate has no cases."""
    rate = lambda flag, of=None: F.avg((F.when(of, flag) if of is not None else flag).cast("double"))
    to_file, asked = F.col("want_outcome") == "file", F.col("outcome") == "clarify"
    return scores.groupBy(*by).agg(
        F.count("*").alias("n"), rate(F.col("success")).alias("success_rate"), rate(F.coalesce(asked, F.lit(False))).alias("clarify_rate"),
        rate(~to_file).alias("expected_clarify_rate"), rate(F.col("success"), to_file).alias("file_success"), rate(F.col("success"), ~to_file).alias("clarify_success"),
        rate(F.col("outcome_right"), ~to_file).alias("clarify_recall"), rate(~to_file, asked).alias("clarify_precision"),
        F.count_if("invented").alias("invented"), F.count_if("needless").alias("needless"), F.count_if("failed").alias("failed"),
    )
