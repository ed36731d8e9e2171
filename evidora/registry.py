"""The functions that a document-QA agent may call, as declared operators: name, purpose, typed inputs and outputs, and what runs them.

A tool is a function of DataFrames; rendering, OCR and models stay with the caller, who gives their outputs as tables or a function for
`mapInPandas`. Sets of tools have names, and a set describes itself as text or as JSON for a prompt.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import evidence, expansion, retrieval


@dataclass(frozen=True)
class Tool:
    name: str
    purpose: str
    inputs: dict[str, str]
    output: str
    run: Callable[..., DataFrame] = field(repr=False)

    def check(self, **frames: DataFrame) -> None:
        """Raise if a named input lacks a column that the tool needs."""
        for name, columns in self.inputs.items():
            if name not in frames:
                raise ValueError(f"{self.name} needs {name}")
            lacks = {c.split()[0] for c in columns.split(", ")} - set(frames[name].columns)
            if lacks:
                raise ValueError(f"{self.name}: {name} lacks {', '.join(sorted(lacks))}")

    def __call__(self, *args, **frames: DataFrame) -> DataFrame:
        self.check(**frames)
        return self.run(*args, **frames)


def _inspect(crops: DataFrame, spans: DataFrame) -> DataFrame:
    return expansion.spans_in_crops(spans, crops, ["doc", "page"])


def _text_layer(spans: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    rows = spans.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "y1", "text"))).alias("s"))  # the spans of a page
    return rows.select("doc", "page", evidence.reading_order(F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["y1"].alias("y1")))).alias("text"))


_BOX = "x0 double, y0 double, x1 double, y1 double"
TOOLS = {
    t.name: t
    for t in (
        Tool("inspect_region", "Text spans whose centre lies in a crop.", {"crops": f"doc string, page int, crop_id string, {_BOX}", "spans": f"doc string, page int, span_id string, {_BOX}"}, "doc, page, crop_id, span_id", _inspect),
        Tool("get_text_layer", "The text of a page in reading order.", {"spans": f"doc string, page int, text string, {_BOX}"}, "doc, page, text", _text_layer),
        Tool("layout_detect", "Recorded detections as regions in page units.", {"boxes": f"doc string, page int, idx int, {_BOX}, width double, height double, label string, score double"}, f"doc, page, region_id, {_BOX}, region_type, score", lambda boxes: expansion.detections(boxes, ["doc"], "page")),
        Tool("expand_context", "Union boxes of target packets by page.", {"packets": f"doc string, page int, packet_id string, target boolean, {_BOX}"}, f"doc, page, n, {_BOX}", lambda packets: expansion.target_unions(packets, ["doc", "page"])),
        Tool("search_pages", "The best pages for a question.", {"pages": "doc string, page int, text string", "questions": "question_id long, question string"}, "question_id, doc, page, score, rank", lambda pages, questions: retrieval.bm25(pages, questions)),
    )
}
#: Named sets: what an agent of each size may use.
SETS = {"plus_2": ("inspect_region", "get_text_layer"), "plus_4": ("inspect_region", "get_text_layer", "layout_detect", "expand_context"), "all": tuple(TOOLS)}


def tool_set(name: str) -> list[Tool]:
    return [TOOLS[t] for t in SETS[name]]


def describe(tools: list[Tool], mode: str = "text") -> str:
    """What the tools do and need, as lines of text or as JSON."""
    if mode == "json":
        return json.dumps([{"name": t.name, "purpose": t.purpose, "inputs": t.inputs, "output": t.output} for t in tools])
    return "\n".join(f"- {t.name}: {t.purpose} Needs {'; '.join(f'{k}({v})' for k, v in t.inputs.items())}. Gives ({t.output})." for t in tools)


def register_sql(spark: SparkSession) -> list[str]:
    """Full-text terms as a SQL function."""
    spark.udf.register("porter_terms", retrieval.porter_terms)
    return ["porter_terms"]
