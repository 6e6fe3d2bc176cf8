"""Questions for a ranking, routed by their words to one of four tables, with the number of rows that they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that choose a ranking.
_HUB = ["hub", "hubs", "centre", "centres", "center", "centers", "warehouse", "warehouses", "facility", "facilities"]
_DWELL = ["dwell", "wait", "waiting", "friction", "idle"]
_FRICTION = ["friction"]
_CORRIDOR = ["corridor", "corridors", "route", "routes", "lane", "lanes"]
_WORST = ["worst", "slowest", "bottleneck", "bottlenecks", "most delayed", "highest"]
_BEST = ["best", "fastest", "quickest", "least delayed"]
_RANK = ["top", "most", "longest", "highest", "worst", "rank", "ranked", "biggest", "largest"]
ROUTES = ["hub_friction", "hub_dwell", "corridor_worst", "corridor_best"]
LEAST, MOST, USUAL = 1, 20, 5


def _says(words: Column, some: list[str]) -> Column:
    return F.greatest(*[words.contains(f" {w} ") for w in some], F.lit(False))


def routed(questions: DataFrame, text: str = "question") -> DataFrame:
    """Add route (null: none of the rankings answers it) and n, the first number of one to three digits, from 1 to 20 (else 5).

    Hubs need a word of dwell and one of ranking; "friction" chooses the share of leg time, any other the minutes.  Corridors
    need a word of worst or best; with both, the worst are given.
    """
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))
    d = questions.withColumn("_words", words)
    w = F.col("_words")
    hub = _says(w, _HUB) & _says(w, _DWELL) & _says(w, _RANK)
    corridor = _says(w, _CORRIDOR)
    route = (
        F.when(hub & _says(w, _FRICTION), "hub_friction").when(hub, "hub_dwell").when(corridor & _says(w, _WORST), "corridor_worst")
        .when(corridor & _says(w, _BEST), "corridor_best")
    )
    asked = F.regexp_extract(w, r" (\d{1,3}) ", 1).try_cast("int")
    return d.withColumn("route", route).withColumn("n", F.when(asked.isNull(), USUAL).otherwise(F.least(F.greatest(asked, F.lit(LEAST)), F.lit(MOST)))).drop("_words")


def rankings(hubs: DataFrame, audited: DataFrame) -> DataFrame:
    """(route, pos, key, value): the first rows that any question may ask for, of supported hubs and of corridors.

    Corridors count where they are confirmed (is_significant, if there is such a column): the worst by excess ratio from
    the top, the best from the bottom.
    """
    sure = F.col("is_significant") if "is_significant" in audited.columns else F.lit(True)
    hub = hubs.where("has_support").select(F.col("centre_code").alias("key"), F.col("median_dwell_share_out").alias("share"), F.col("median_dwell_min_out").alias("minutes"))
    lane = audited.where(sure).select(F.col("corridor_id").alias("key"), "excess_ratio")
    first = lambda d, route, value, down: (
        d.where(F.col(value).isNotNull()).orderBy(F.col(value).desc() if down else F.col(value), "key").limit(MOST)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col(value) if down else F.col(value)).alias("by"), "key", F.col(value).alias("value")))).alias("rows"))
        .select(F.lit(route).alias("route"), F.posexplode("rows").alias("at", "r")).select("route", (F.col("at") + 1).alias("pos"), "r.key", "r.value")
    )
    out = first(hub, "hub_friction", "share", True).unionByName(first(hub, "hub_dwell", "minutes", True))
    return out.unionByName(first(lane.where("excess_ratio > 1"), "corridor_worst", "excess_ratio", True)).unionByName(first(lane.where("excess_ratio < 1"), "corridor_best", "excess_ratio", False))


def answered(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Routed questions with the rows that they ask for; those without a route are refused and have none.

    ``ranked`` has at most MOST rows a route, so it goes to every task.
    """
    lists = ranked.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "value"))).alias("rows"))
    d = questions.join(F.broadcast(lists), "route", "left")
    return d.withColumn("rows", F.when(F.col("route").isNotNull(), F.slice("rows", F.lit(1), F.col("n"))))
