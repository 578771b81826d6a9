"""Play-by-play tables derived from the generic star-schema test tables.

Every line item is read as one play: brand bats, supplier pitches, the ship
quarter is the game. The same definitions are in SQL in ``oracles.PLAYS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: total order of plays
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

# Invented season weights, a step apart; the last season of the data has none on purpose.
CONSTANT_COLUMNS = ("Season", "wBB", "wHBP", "w1B", "w2B", "w3B", "wHR", "cFIP")
CONSTANTS = (
    (1995, 0.61, 0.66, 0.81, 1.17, 1.48, 1.86, 2.9),
    (1996, 0.62, 0.67, 0.82, 1.18, 1.49, 1.87, 2.95),
    (1997, 0.63, 0.68, 0.83, 1.19, 1.5, 1.88, 3.0),
    (1998, 0.64, 0.69, 0.84, 1.2, 1.51, 1.89, 3.05),
    (1999, 0.65, 0.7, 0.85, 1.21, 1.52, 1.9, 3.1),
    (2000, 0.66, 0.71, 0.86, 1.22, 1.53, 1.91, 3.15),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constants(spark: SparkSession) -> DataFrame:
    rows = ", ".join("({}, {})".format(r[0], ", ".join(f"{v}D" for v in r[1:])) for r in CONSTANTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(CONSTANT_COLUMNS)})")


def _quarter_number():
    return F.year("l_shipdate") * 10 + F.quarter("l_shipdate")


def _gameid():
    return F.concat(F.lit("G"), _quarter_number().cast("string"))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    lines = table(spark, sf_dir, "lineitem")
    number, quantity = F.col("l_linenumber"), F.col("l_quantity")
    code = (
        F.when(number == 7, 15)
        .when((number == 6) & (quantity < 10), 0)
        .when((number == 5) & (quantity > 45), 22)
        .when((number == 5) & (quantity < 6), 16)
        .when((number == 4) & (quantity < 4), 99)
        .when((number == 3) & (quantity < 4), 18)
        .when((number == 2) & (quantity < 4), 1)
    )
    kinds = F.expr("map('AF', 20, 'AO', 2, 'NF', 14, 'NO', 3, 'RF', 21, 'RO', 23)")
    code = code.otherwise(kinds[F.concat("l_returnflag", "l_linestatus")])
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.year("l_shipdate").alias("season"),
        _gameid().alias("gameid"),
        F.col("p_brand").alias("batter"),
        F.col("l_suppkey").cast("string").alias("pitcher"),
        F.when(F.col("p_size") % 25 == 0, F.lit(None))
        .when(F.col("p_size") % 2 == 0, "L")
        .otherwise("R")
        .alias("batterhand"),
        F.when(F.col("l_suppkey") % 2 == 0, "L").otherwise("R").alias("pitcherhand"),
        code.alias("eventtype"),
        F.when(quantity == 1, "F").otherwise("T").alias("battereventflag"),
        F.when(F.col("l_tax") == 0, "T").otherwise("F").alias("shflag"),
        F.when(F.col("l_discount") == 0, "T").otherwise("F").alias("sfflag"),
        *ORDER,
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game; one game is missing so that a left join shows."""
    number = _quarter_number()
    site = F.concat(
        F.lit("S"), ((F.year("l_shipdate") * 4 + F.quarter("l_shipdate")) % 12).cast("string")
    )
    return (
        table(spark, sf_dir, "lineitem")
        # text is made of the few quarters, not of every line; Spark would leave out a mere distinct()
        .groupBy(F.trunc("l_shipdate", "quarter").alias("l_shipdate"))
        .agg(F.count(F.lit(1)).alias("lines"))
        .filter((F.col("lines") > 0) & (number != 19972))
        .groupBy(_gameid().alias("gameid"))
        .agg(F.min(site).alias("gamesite"))
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitcher names; every seventh supplier is left out."""
    return (
        table(spark, sf_dir, "supplier")
        .filter(F.col("s_suppkey") % 7 != 0)
        .select(F.col("s_suppkey").cast("string").alias("ID"), F.col("s_name").alias("Name"))
    )


def batter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batter names from part: a brand's cheapest part name; no name for some."""
    return (
        table(spark, sf_dir, "part")
        .filter(~F.col("p_brand").endswith("5"))
        .groupBy(F.col("p_brand").alias("ID"))
        .agg(F.min("p_name").alias("Name"))
    )


def parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "nation")
        .filter(F.col("n_nationkey").between(1, 10))
        .select(
            F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("PARKID"),
            F.col("n_name").alias("NAME"),
        )
    )


def season_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player-season stat lines from orders, one order counting as one game."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy(
            F.col("c_name").alias("Name"),
            F.year("o_orderdate").alias("Season"),
            F.col("c_mktsegment").alias("Team"),
        )
        .agg(
            F.count(F.lit(1)).alias("G"),
            F.sum(key % 5 + 1).alias("PA"),
            F.sum(key % 4).alias("RBI"),
            F.sum(key % 6).alias("wRC"),
            F.sum(key % 7 - 3).alias("wRAA"),
            F.sum(key % 3 - 1).alias("BsR"),
            F.sum(price % 40 - 20).alias("Bat"),
            F.sum(price % 30 - 15).alias("Def"),
            F.sum(key % 2).alias("WAR"),
        )
        .withColumn("Off", F.col("Bat") + F.col("BsR"))
    )


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pitches; only light ones end a plate appearance."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("index"),
        F.to_date("l_shipdate").alias("game_date"),
        F.col("l_partkey").alias("batter"),
        F.col("l_suppkey").alias("pitcher"),
        F.when(F.col("l_quantity") <= 12, F.col("l_returnflag")).alias("events"),
        F.lit("R").alias("stand"),
        F.when(F.col("l_suppkey") % 2 == 0, "L").otherwise("R").alias("p_throws"),
        F.lit("H").alias("home_team"),
        F.lit("A").alias("away_team"),
    )


BOARD_ID = "board"
BOARD_COLUMNS = ("#", "Name", "Nation", "Segment", "Balance")
PAGE_ROWS = 50


def board_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leaderboard pages of at most 50 rows, one HTML table each."""

    def td(value):
        return F.concat(F.lit("<td>"), value, F.lit("</td>"))

    key = F.col("c_custkey")
    place = key % PAGE_ROWS
    row = F.concat(
        F.lit("<tr>"),
        td(place.cast("string")),
        td(F.concat(F.lit('<a href="/p">'), F.col("c_name"), F.lit("</a>"))),
        td(F.col("c_nationkey").cast("string")),
        td(F.concat(F.lit("<b>A&amp;B</b> "), F.col("c_mktsegment"))),
        F.when(place % 10 != 0, td(F.floor("c_acctbal").cast("string"))).otherwise(""),
        F.lit("</tr>"),
    )
    heads = "".join(f"<th>{name}</th>" for name in BOARD_COLUMNS)
    top = (
        f'<html><body><table><tr><td>menu</td></tr></table><table id="{BOARD_ID}"><thead>'
        f"<tr><td>1 of 1</td></tr><tr>{heads}</tr><tr><td>-</td></tr></thead>"
        "<tbody></tbody><tbody>"
    )
    # c_custkey is unique, so a page gathers at most PAGE_ROWS rows
    lines = F.array_sort(F.collect_list(F.struct(key.alias("k"), row.alias("h"))))
    body = F.array_join(F.transform(lines, lambda line: line["h"]), "")
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.floor(key / PAGE_ROWS).alias("page_id"))
        .agg(F.concat(F.lit(top), body, F.lit("</tbody></table></body></html>")).alias("html"))
    )


def text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scraped text: one column of numbers, two that are not."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        key.cast("string").alias("number"),
        F.when(key % 10 == 0, "--").otherwise(F.col("c_nationkey").cast("string")).alias("mixed"),
        F.col("c_name").alias("word"),
    )
