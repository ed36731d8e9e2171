"""Queries of packets, with their DuckDB SQL: packets spell values of the tables, and the SQL works from the values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog as cat
from .operators import evidence as ev
from .sources import views as vw

query = cat.query
FOCUS = ("Gain | 3", "Min typ  max of the unit", "Rated test condition", "Plain  words here", "")
REGIONS = ("table", "Bar Chart", "picture", "", "Text block")
ROLES = ("caption", "X-Axis", "Page Header", " ", "Other note", "footer")
#: Orders' years are told as years of this many later, so that all are of this century.
LATER = 10
#: Amounts with a thousands' comma are read as money.
COMMA = 1000


def _spelled(c):
    return F.format_number(c.cast("long"), 0)


def fiscal_packets(spark, sf_dir) -> DataFrame:
    """Two packets a customer: repurchases (least and largest order of each year) and dividends (their sum, or six multiples of it)."""
    o = vw.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), (F.year("o_orderdate") + LATER).alias("y"), F.floor("o_totalprice").cast("long").alias("v"))
    years = o.groupBy("c", "y").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
    multiples = F.concat_ws(" ", *[_spelled(F.col("total") * i) for i in range(1, 7)])
    paid = F.when(F.col("c") % 4 == 0, F.concat(F.lit(" (in millions) "), multiples)).otherwise(F.concat(F.lit(" "), _spelled(F.col("total"))))
    line = F.struct("y", F.concat(F.col("y").cast("string"), F.lit(" "), _spelled(F.col("least")), F.lit(" then "), _spelled(F.col("most"))).alias("bought"), F.when(F.col("n") > 1, F.concat(F.col("y").cast("string"), paid)).alias("paid"))
    told = years.groupBy("c").agg(F.sort_array(F.collect_list(line)).alias("lines"))  # one entry a year
    packets = told.select("c", F.inline(F.array(
        F.struct(F.lit("p1").alias("packet_id"), F.concat(F.lit("Share repurchases "), F.array_join("lines.bought", "; ")).alias("text")),
        F.struct(F.lit("p2").alias("packet_id"), F.concat(F.lit("Dividends declared "), F.array_join("lines.paid", "; ")).alias("text")),
    )))
    asked = F.concat(F.lit("What is the ratio of repurchases to dividends in fiscal year "), (F.col("c") % 9 + 2003).cast("string"), F.lit("?"))
    return packets.select(F.col("c").cast("string").alias("example_id"), "packet_id", "text", asked.alias("question"))


@query(f"""WITH y AS (SELECT o_custkey AS c, year(o_orderdate) + {LATER} AS y, max(floor(o_totalprice)) AS b, sum(floor(o_totalprice)) AS s, count(*) AS n FROM orders GROUP BY 1, 2),
a AS (SELECT c, CASE WHEN b >= {COMMA} THEN b END AS b, CASE WHEN n > 1 THEN list_filter(CASE WHEN c % 4 = 0 THEN [s, 2 * s, 3 * s, 4 * s, 5 * s, 6 * s] ELSE [s] END, lambda x: x >= {COMMA}) END AS paid, c % 4 = 0 AS millions FROM y WHERE y = c % 9 + 2003),
p AS (SELECT c, b, CASE WHEN millions AND len(paid) >= 5 THEN paid[5] ELSE paid[-1] END AS p FROM a)
SELECT c::VARCHAR AS example_id, printf('%.2f', round(b / p, 2)) AS answer FROM p WHERE b > 0 AND p > 0""")
def fiscal_year_ratios(spark, sf_dir):
    return ev.repurchase_ratio(fiscal_packets(spark, sf_dir))


def segment_packets(spark, sf_dir) -> DataFrame:
    """Two packets a customer: acquisitions by segment with a total, and the purchase price, as a sentence or in a table of its own."""
    o = vw.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.concat(F.lit("Segment "), F.translate(F.substring("o_orderpriority", 1, 1), "12345", "ABCDE")).alias("seg"), F.floor("o_totalprice").cast("long").alias("v"))
    parts = o.groupBy("c", "seg").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    row = F.struct("seg", F.concat_ws(" | ", "seg", F.col("n").cast("string"), _spelled(F.col("v"))).alias("cells"))
    told = parts.groupBy("c").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum("v").alias("total"), F.sum("n").alias("n"))  # one entry a segment
    price = _spelled(F.col("total") * (F.col("c") % 3 + 1))
    table = F.concat(F.lit("headers: Segment | Opening | Acquisition\ncandidate_rows: "), F.array_join("rows.cells", " | "), F.lit(" | Total | "), F.col("n").cast("string"), F.lit(" | "), _spelled(F.col("total")))
    stated = F.when(F.col("c") % 2 == 0, F.concat(F.lit("The total purchase price was $"), price, F.lit("."))).otherwise(F.concat(F.lit("headers: Item | Cost\ncandidate_rows: Purchase price | "), price))
    packets = told.select("c", F.inline(F.array(F.struct(F.lit("p1").alias("packet_id"), table.alias("text")), F.struct(F.lit("p2").alias("packet_id"), stated.alias("text")))))
    return packets.select(F.col("c").cast("string").alias("example_id"), "packet_id", "text")


@query(f"""WITH s AS (SELECT o_custkey AS c, o_orderpriority[1] AS seg, sum(floor(o_totalprice)) AS v FROM orders GROUP BY 1, 2), t AS (SELECT c, max(v) AS s, sum(v) * (c % 3 + 1) AS t FROM s GROUP BY c),
a AS (SELECT c, s, t, round_even(s / t * 100, 0) AS share FROM t WHERE s > 0 AND s < t AND (c % 2 = 1 OR t >= {COMMA}))
SELECT c::VARCHAR AS example_id, share::BIGINT || '%' AS answer FROM a WHERE share BETWEEN 1 AND 99""")
def segment_shares(spark, sf_dir):
    return ev.segment_percent(segment_packets(spark, sf_dir))


def region_packets(spark, sf_dir) -> DataFrame:
    """One packet an order: a line of its own and two lines of context, whose roles are spelled in several ways."""
    o = vw.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    context = lambda role, v: F.concat(F.lit("Context ["), role, F.lit("]:  value   "), (v % 10).cast("string"))
    text = F.concat_ws("\n", vw.pick(FOCUS, k), context(vw.pick(ROLES, c), k), F.lit("  "), context(vw.pick(ROLES, k + c), c))
    return o.select(k.cast("string").alias("packet_id"), c.alias("customer"), vw.pick(REGIONS, c).alias("region_type"), text.alias("text"), F.when(k % 7 == 0, "1,2").alias("chart_csv"))


_ROLE = lambda n: f"(CASE {vw.sql_pick(ROLES, n)} WHEN 'X-Axis' THEN 'axis' WHEN 'Page Header' THEN 'header' WHEN ' ' THEN 'context' WHEN 'Other note' THEN 'other_note' ELSE {vw.sql_pick(ROLES, n)} END)"


@query(f"""WITH p AS (SELECT o_orderkey AS k, o_custkey AS c, {vw.sql_pick(REGIONS, 'o_custkey')} AS region, replace({vw.sql_pick(FOCUS, 'o_orderkey')}, '  ', ' ') AS focus, {_ROLE('o_custkey')} AS r1, {_ROLE('(o_orderkey + o_custkey)')} AS r2, 'value ' || o_orderkey % 10 AS v1, 'value ' || o_custkey % 10 AS v2 FROM orders),
t AS (SELECT *, len(list_filter(['parameter', 'test', 'condition', 'unit', 'min', 'typ', 'max'], lambda w: list_contains(string_split(lower(focus), ' '), w))) AS terms FROM p)
SELECT k::VARCHAR AS packet_id, focus AS focus_text, CASE WHEN k % 7 = 0 OR region = 'Bar Chart' OR (c % 3 = 0 AND region = 'picture') THEN 'chart' WHEN region = 'table' OR contains(focus, '|') OR terms >= 3 THEN 'table' WHEN region = 'picture' THEN 'visual' ELSE 'text' END AS group_kind,
  CASE WHEN r1 = r2 AND v1 = v2 THEN r1 || '=' || v1 WHEN r1 = r2 THEN r1 || '=' || v1 || '/' || v2 ELSE r1 || '=' || v1 || '; ' || r2 || '=' || v2 END AS context FROM t""")
def evidence_groups(spark, sf_dir):
    """Packets with their kind, the line they are about and context by role."""
    g = ev.groups(region_packets(spark, sf_dir), F.col("customer") % 3 == 0)
    told = F.transform(F.map_entries("context"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "/")))
    return g.select("packet_id", "focus_text", "group_kind", F.array_join(told, "; ").alias("context"))


@query("SELECT group_kind, count(*) AS n FROM (" + cat.ORACLE_SQL["evidence_groups"] + ") GROUP BY 1")
def evidence_group_counts(spark, sf_dir):
    return evidence_groups(spark, sf_dir).groupBy("group_kind").agg(F.count(F.lit(1)).alias("n"))
