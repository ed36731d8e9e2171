"""Readers and sinks for runs, predictions and benchmarks. Schemas are explicit: nothing is inferred at query time."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = "struct<page:int,x0:double,y0:double,x1:double,y1:double>"
STEP = "struct<step_index:int,stage:string,tier:string,action:string,tool:string,args:string,tokens_in:long,tokens_out:long,latency_ms:long,usd:double,confidence:double>"
#: The fact table. args and payloads stay JSON text and are parsed where they are used.
RECORD_SCHEMA = (
    "example_id string, protocol string, domain string, answer_pred string, answer_gold string, answer_correct double, page_recall double, bbox_iou double, "
    "evidence_reward double, is_lazy int, tool_calls int, tokens_in long, tokens_out long, usd double, latency_ms double, "
    "citations array<struct<page:int,bbox:array<double>>>, cache_hit boolean, error string, "
    "telemetry struct<retries_used:int,loop_terminated:string,loop_retry_helped:boolean>, "
    f"trace struct<steps:array<{STEP}>>"
)
RAW_EXAMPLE_SCHEMA = (
    "id string, domain string, source_pdf string, question string, answer string, answer_type string, answer_unit string, tolerance float, "
    "supporting_pages array<int>, supporting_bboxes string, alternate_bboxes string, multi_region_required boolean, requires_visual boolean, "
    "difficulty_visual int, difficulty_reasoning int, difficulty_localization int, question_family string, stress_type string, "
    "reasoning_chain string, evidence_page_spread int, adversarial_type string, split string"
)
#: Columns that may come as JSON texts. Objects within a list of texts keep their JSON.
JSON_FIELDS = {
    "supporting_bboxes": f"array<{BOX}>", "alternate_bboxes": f"array<{BOX}>", "original_bboxes": f"array<{BOX}>", "evidence_relations": "array<string>",
    "difficulty": "struct<visual:int,reasoning:int,localization:int>", "supporting_pages": "array<int>", "page_images": "array<variant>", "distractor_region_ids": "array<string>",
}
# Names of splits.
SPLITS = {"validation": "dev", "val": "dev"}


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of JSON lines or one JSON file each, with their run (the folder of the file); corrupt lines are dropped."""
    df = spark.read.schema(RECORD_SCHEMA).option("mode", "DROPMALFORMED").json(list(paths))
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"/(?:predictions/)?[^/]+$", "")
    return df.select("*", F.element_at(F.split(folder, "/"), -1).alias("run")).where("example_id is not null")


def read_examples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read if fmt == "parquet" else spark.read.schema(RAW_EXAMPLE_SCHEMA)
    return reader.format(fmt).load(path)


def drop_stress(df: DataFrame) -> DataFrame:
    """Rows without a stress type; all rows if the column is absent."""
    return df.where(F.coalesce("stress_type", F.lit("")).isin("", "none")) if "stress_type" in df.columns else df


def stress_counts(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("stress_type", F.lit("")).isin("", "none")).groupBy("stress_type").agg(F.count(F.lit(1)).alias("n"))


def decoded(raw: DataFrame) -> DataFrame:
    """JSON_FIELDS that are texts as values, null where a text is no such JSON; columns that are typed already stay as they are.

    Of page_images only the texts among the entries are kept.
    """
    texts = {c for c, t in raw.dtypes if c in JSON_FIELDS and t == "string"}
    value = {c: F.from_json(c, JSON_FIELDS[c]) for c in texts}
    if "page_images" in texts:
        image = F.filter(value["page_images"], lambda v: F.schema_of_variant(v) == "STRING")
        value["page_images"] = F.transform(image, lambda v: F.variant_get(v, "$", "string"))
    return raw.withColumns(value)


def typed_examples(raw: DataFrame) -> DataFrame:
    """Raw rows with JSON texts decoded, boxes never null, the split's own name and difficulty as one struct, 1 where it is not given or zero."""
    df = decoded(raw)
    split = F.coalesce(F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])[F.lower("split")], F.lower("split"))
    level = lambda d: F.coalesce(F.nullif(F.col(f"difficulty_{d}"), F.lit(0)), F.lit(1)).cast("int") if f"difficulty_{d}" in df.columns else F.lit(1)
    levels = F.struct(*[level(d).alias(d) for d in ("visual", "reasoning", "localization")])
    boxes = {c: F.coalesce(c, F.array().cast(f"array<{BOX}>")) for c in ("supporting_bboxes", "alternate_bboxes")}
    given = {"difficulty": F.coalesce("difficulty", levels) if "difficulty" in df.columns else levels}
    return df.withColumns({**boxes, "split": split, **given}).drop("difficulty_visual", "difficulty_reasoning", "difficulty_localization")


def page_images(raw: DataFrame, images: str = "page_images") -> DataFrame:
    """id, page, image: the i-th image is of the i-th supporting page, or of page i + 1 beyond them."""
    return raw.select("id", F.posexplode(images).alias("i", "image"), "supporting_pages").select("id", F.coalesce(F.get("supporting_pages", F.col("i")), F.col("i") + 1).alias("page"), "image")


def with_unique_ids(df: DataFrame, order: list[str], id_column: str = "example_id", position: str | None = None) -> DataFrame:
    """unique_id: a missing or empty id becomes row-NNNN by the row's position, the k-th repeat of an id gets the suffix __k.

    position: the column that has it (a line number). Without one, rows without an id are numbered in blocks by a hash of their order,
    so that they are no single hot group: row-<block>-<place>.
    """
    none = F.col(id_column).isNull() | (F.col(id_column) == "")
    block = F.when(none, F.pmod(F.xxhash64(*order), F.lit(1000))).otherwise(-1)
    w = Window.partitionBy(F.when(~none, F.col(id_column)), block).orderBy(*order)
    k = F.row_number().over(w)
    made = F.format_string("row-%04d", F.col(position).cast("long")) if position else F.format_string("row-%03d-%04d", block.cast("int"), k.cast("int"))
    named = F.when(none, made).when(k > 1, F.concat(F.col(id_column), F.lit("__"), k.cast("string"))).otherwise(F.col(id_column))
    return df.withColumn("unique_id", named)


def last_by_id(df: DataFrame, order: list[str], id_column: str = "id") -> DataFrame:
    """One row an id: the last in order. A maximum by struct, so rows combine before the shuffle."""
    rest = [c for c in df.columns if c != id_column]
    best = df.groupBy(id_column).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(id_column, *[F.col(f"r.{c}").alias(c) for c in rest])


def read_split(spark: SparkSession, folder: str, split: str, limit: int | None = None) -> DataFrame:
    """Raw examples of one split as JSON lines: <split>.jsonl, or candidates.jsonl where that is missing, rows of the split or of none; limit is the caller's."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{split}.jsonl")
    own = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    df = spark.read.schema(RAW_EXAMPLE_SCHEMA).json(f"{folder}/{split if own else 'candidates'}.jsonl").where(F.col("id").isNotNull())
    df = df.where(F.col("split").isNull() | (F.col("split") == split))
    return df if limit is None else df.limit(limit)


def doc_stem(example_id):
    """The document part of an id '<domain>-<document>-<number>'."""
    return F.regexp_extract(example_id, r"^(?:[a-z]{3}-)?(.+?)(?:-\d+)?$", 1)


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and an order-free checksum of all columns."""
    total = F.sum(F.col("h").cast("decimal(38,0)"))  # a sum, so that repeated rows count
    return df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.coalesce(total, F.lit(0)).cast("string"), 256).alias("fingerprint"))


def write_run(records: DataFrame, manifest: dict, path: str) -> None:
    """per_example as JSON lines and the manifest beside it; one write each, through Spark's own file systems."""
    records.write.mode("overwrite").json(f"{path}/per_example")
    records.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run")


def write_table(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A result as json, csv, parquet or markdown."""
    if fmt == "markdown":
        cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in df.columns])
        head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "o int, value string")
        body = df.select(F.lit(2).alias("o"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))
        head.union(body).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)
    else:
        w = df.write.mode("overwrite")
        (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


# ---- recorded responses: the engine never calls a model


def canonical_json(**fields):
    """JSON of named columns in the order of their names, doubles at four places: equal requests spell alike."""
    spelled = lambda v: F.when(v.cast("string").isNull(), "null").otherwise(v.cast("string"))
    parts = [F.concat(F.lit(f'"{k}":'), spelled(v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_number(v, places: int = 4):
    return F.format_string(f"%.{places}f", v.cast("double"))


def json_text(v):
    return F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)


def cache_key(*parts: str):
    """The content key of a request: sha256 over its canonical parts."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def replay(requests: DataFrame, recorded: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(requests with their recorded responses, requests without one)."""
    return requests.join(recorded, key, "inner"), requests.join(recorded.select(key), key, "left_anti")


def record_or_replay(requests: DataFrame, recorded: DataFrame, call, schema: str, key: str = "key") -> DataFrame:
    """Recorded responses, and `call` (an iterator of pandas frames to frames) for the misses."""
    hit, miss = replay(requests, recorded, key)
    return hit.unionByName(miss.mapInPandas(call, schema), allowMissingColumns=True)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of files, read by Spark's binary source."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
