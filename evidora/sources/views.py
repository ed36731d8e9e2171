"""Evaluation-shaped views of the driver's tables: each is a projection that reads only the columns it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: name -> expression over lineitem; plain arithmetic that reads alike in every SQL dialect.
RECORDS = {
    "example_id": "l_orderkey",
    "line": "l_linenumber",
    "part": "l_partkey",
    "supp": "l_suppkey",
    "domain": "l_returnflag",
    "run": "l_linestatus",
    "answer_correct": "CASE WHEN l_quantity > 25 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "page_recall": "l_discount * 10",
    "bbox_iou": "l_tax * CAST(12.5 AS DOUBLE)",
    "usd": "l_extendedprice / CAST(1000000 AS DOUBLE)",
    "latency_ms": "l_quantity * 100",
    "is_lazy": "CASE WHEN l_discount = 0 THEN 1 ELSE 0 END",
    "tool_calls": "l_linenumber",
}
BOXES = {
    "doc": "l_orderkey",
    "part": "l_partkey",
    "supp": "l_suppkey",
    "line": "l_linenumber",
    "page": "l_linenumber % 2",
    "x0": "l_discount * 5",
    "y0": "l_tax * CAST(6.25 AS DOUBLE)",
    "x1": "l_discount * 5 + l_quantity / CAST(100 AS DOUBLE)",
    "y1": "l_tax * CAST(6.25 AS DOUBLE) + (l_partkey % 50 + 1) / CAST(100 AS DOUBLE)",
    "score": "l_extendedprice / CAST(105000 AS DOUBLE)",
    "region_type": "CASE l_suppkey % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'caption' WHEN 2 THEN 'footnote' WHEN 3 THEN 'picture' WHEN 4 THEN 'section_header' ELSE 'text' END",
    "is_gold": "l_linestatus = 'F'",
}
STEPS = {
    "trace": "user_id",
    "ts": "ts",
    "event_id": "event_id",
    "stage": "event_type",
    "latency": "value",
    "tool": "CASE WHEN event_type IN ('click', 'purchase') THEN event_type END",
    "props": "props",
}


def pick(xs, key):
    """One of some texts by a key, in turn."""
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (key % len(xs) + 1).cast("int"))


def sql_pick(xs, key: str) -> str:
    """The same in DuckDB SQL."""
    return f"[{', '.join(repr(x) for x in xs)}][({key} % {len(xs)} + 1)::INT]"


def _project(df: DataFrame, view: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in view.items()])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "lineitem"), RECORDS)


def numbered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with occurrence: the running number of an example within its run, for pairing repeated ids."""
    w = Window.partitionBy("run", "example_id").orderBy("line", "part", "supp")
    return records(spark, sf_dir).withColumn("occurrence", F.row_number().over(w).cast("long"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "lineitem"), BOXES)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), STEPS).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted answers of every type, made from orders."""
    o = table(spark, sf_dir, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("AnswerType.NUMERIC", "boolean", "AnswerType.MULTIPLE_CHOICE", "exact_match", "unanswerable")]), (key % 5 + 1).cast("int"))
    cents = F.floor(price).cast("long").cast("string")
    gold = (
        F.when(key % 5 == 0, cents)
        .when(key % 5 == 1, F.when(key % 2 == 0, "Yes, it is").otherwise("no"))
        .when(key % 5 == 2, F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (key % 3 + 1).cast("int")))
        .when(key % 5 == 3, F.concat(F.col("o_orderpriority"), F.lit("; status "), F.col("o_orderstatus")))
        .otherwise("unanswerable")
    )
    pred = (
        F.when(key % 5 == 0, F.concat(F.lit("about $"), (F.floor(price) + key % 7 * 300).cast("long").cast("string"), F.lit(" USD")))
        .when(key % 5 == 1, F.when(key % 3 == 0, "TRUE").otherwise("No."))
        .when(key % 5 == 2, F.concat(F.lit("Option ("), F.element_at(F.array(*[F.lit(x) for x in "abcde"]), (key % 4 + 1).cast("int")), F.lit(")")))
        .when(key % 5 == 3, F.when(key % 4 == 0, F.upper("o_orderpriority")).otherwise(F.concat(F.col("o_orderpriority"), F.lit(" (stated)"))))
        .otherwise(F.when(key % 4 == 0, "It cannot be determined.").otherwise("42"))
    )
    return o.select(key.alias("example_id"), kind.alias("answer_type"), gold.alias("gold"), pred.alias("pred"), F.when(key % 10 == 0, F.lit(1000.0)).alias("tolerance"), F.col("o_orderpriority").alias("domain"))


#: The same view in DuckDB SQL.
ANSWERS_SQL = """
SELECT o_orderkey AS example_id, ['AnswerType.NUMERIC', 'boolean', 'AnswerType.MULTIPLE_CHOICE', 'exact_match', 'unanswerable'][(o_orderkey % 5 + 1)::INT] AS answer_type,
  CASE o_orderkey % 5 WHEN 0 THEN floor(o_totalprice)::BIGINT::VARCHAR WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Yes, it is' ELSE 'no' END
    WHEN 2 THEN ['A','B','C','D','E'][(o_orderkey % 3 + 1)::INT] WHEN 3 THEN o_orderpriority || '; status ' || o_orderstatus ELSE 'unanswerable' END AS gold,
  CASE o_orderkey % 5 WHEN 0 THEN 'about $' || (floor(o_totalprice)::BIGINT + o_orderkey % 7 * 300)::VARCHAR || ' USD'
    WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'TRUE' ELSE 'No.' END WHEN 2 THEN 'Option (' || ['a','b','c','d','e'][(o_orderkey % 4 + 1)::INT] || ')'
    WHEN 3 THEN CASE WHEN o_orderkey % 4 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority || ' (stated)' END
    ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'It cannot be determined.' ELSE '42' END END AS pred,
  CASE WHEN o_orderkey % 10 = 0 THEN 1000.0::DOUBLE END AS tolerance, o_orderpriority AS domain FROM orders
"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, text: documents as pages of their source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions with the document that each is asked of."""
    return questions(spark, sf_dir).withColumn("doc", F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def sql_view(name: str) -> str:
    """The view over lineitem or events as a DuckDB subquery."""
    view, src = {"records": (RECORDS, "lineitem"), "boxes": (BOXES, "lineitem"), "steps": (STEPS, "events")}[name]
    more = ", CAST(json_extract_string(props, '$.k') AS BIGINT) AS k" if name == "steps" else ""
    return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in view.items())}{more} FROM {src})"
