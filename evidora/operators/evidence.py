"""Evidence packets as rows: context roles, reading order, table rows in notes, deterministic finance answers, retries.

Everything works on arrays within one packet or example, which are short, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import squeeze
from ..functions.shapes import bind

# Names under which a context role may be written.
ROLE_NAMES = {
    "axis_label": "axis", "x_axis": "axis", "y_axis": "axis", "caption_context": "caption", "footer": "footer", "page_footer": "footer",
    "header_disambiguation": "header", "page_header": "header", "section_header": "header", "legend_binding": "legend", "table_cell_lookup": "table_context",
}
TABLE_TYPES, CHART_TYPES, VISUAL_TYPES = ("table",), ("chart", "bar_chart", "line_chart", "pie_chart", "scatter_plot"), ("picture", "figure", "chart", "image")
CONTEXT_LINE = r"(?i)^context\s*\[([^\]]+)\]\s*:\s*(.+)$"
AMOUNT = r"^-?\d+(?:,\d{3})*(?:\.\d+)?$"
MONEY = r"(\$?\s*\d{1,3}(?:,\d{3})+(?:\.\d+)?)"


def role_name(role: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(role, F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    known = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv]), key)
    return F.when(key == "", "context").otherwise(F.coalesce(known, key))


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def primary_text(text: Column) -> Column:
    return F.array_join(F.filter(lines_of(text), lambda x: ~x.rlike(CONTEXT_LINE)), "\n")


def context_by_role(text: Column, limit: int = 240) -> Column:
    """map role -> distinct context texts in order, from 'Context [role]: text' lines."""
    rows = F.transform(F.filter(lines_of(text), lambda x: x.rlike(CONTEXT_LINE)), lambda x: F.struct(role_name(F.regexp_extract(x, CONTEXT_LINE, 1)).alias("role"), F.substring(squeeze(F.regexp_extract(x, CONTEXT_LINE, 2)), 1, limit).alias("t")))
    roles = F.array_distinct(F.transform(rows, lambda r: r["role"]))
    return F.map_from_arrays(roles, F.transform(roles, lambda k: F.array_distinct(F.transform(F.filter(rows, lambda r: r["role"] == k), lambda r: r["t"]))))


def group_kind(region_type: Column, focus: Column, chart_csv: Column, chart_asked: Column) -> Column:
    """chart, table, visual or text."""
    kind = F.regexp_replace(F.lower(F.coalesce(region_type, F.lit(""))), r"[^a-z0-9]+", "_")
    terms = F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower(focus), F.lit(r"([a-z]+)"), F.lit(1))), F.array(*[F.lit(x) for x in ("parameter", "test", "condition", "unit", "min", "typ", "max")])))
    table = kind.isin(*TABLE_TYPES) | focus.contains("|") | (terms >= 3)
    return F.when((F.coalesce(chart_csv, F.lit("")) != "") | kind.isin(*CHART_TYPES) | (chart_asked & kind.isin(*VISUAL_TYPES)), "chart").when(table, "table").when(kind.isin(*VISUAL_TYPES), "visual").otherwise("text")


def groups(packets: DataFrame, chart_asked: Column | None = None) -> DataFrame:
    """packets (packet_id, page, region_type, text, chart_csv, ...) with focus_text, context and group_kind."""
    df = packets.withColumns({"focus_text": F.substring(squeeze(primary_text(F.col("text"))), 1, 600), "context": context_by_role(F.col("text"))})
    return df.withColumn("group_kind", group_kind(F.col("region_type"), F.col("focus_text"), F.col("chart_csv"), F.lit(False) if chart_asked is None else chart_asked))


def reading_order(spans: Column, tolerance: float = 3.0) -> Column:
    """Text of spans [{text, x0, y0, y1}] in their order: a new line where the centre leaves the line's running baseline."""
    start = F.struct(F.array().cast("array<array<struct<x0:double,text:string>>>").alias("done"), F.array().cast("array<struct<x0:double,text:string>>").alias("line"), F.lit(None).cast("double").alias("y"))

    def step(acc: Column, s: Column) -> Column:
        y = (s["y0"] + s["y1"]) / 2
        one = F.array(F.struct(s["x0"].cast("double").alias("x0"), s["text"].alias("text")))
        stay = acc["y"].isNull() | (F.abs(y - acc["y"]) <= tolerance)
        return F.struct(
            F.when(stay, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))).alias("done"),
            F.when(stay, F.concat(acc["line"], one)).otherwise(one).alias("line"),
            F.when(acc["y"].isNull() | ~stay, y).otherwise((acc["y"] + y) / 2).alias("y"),
        )

    join = lambda line: F.array_join(F.filter(F.transform(F.array_sort(line), lambda s: F.trim(s["text"])), lambda t: t != ""), " ")
    return F.aggregate(spans, start, step, lambda acc: F.array_join(F.filter(F.transform(F.concat(acc["done"], F.array(acc["line"])), join), lambda t: t != ""), "\n"))


# ---- table rows in notes and the finance programs


def clean_amount(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[,;.]+$", ""), r"^\$\s*", "")


def amount(c: Column) -> Column:
    return bind(clean_amount(c), lambda v: F.when(v.rlike(AMOUNT), F.regexp_replace(v, ",", "").try_cast("double")))


def headers(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_extract(text, r"(?im)^headers:\s*(.+)$", 1), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def table_rows(text: Column) -> Column:
    """[{label, vals}] from 'headers:' and 'candidate_rows:' lines: a label and as many values as there are headers after the first."""
    none = F.array().cast("array<struct<label:string,vals:array<string>>>")
    tokens = F.filter(F.transform(F.split(F.regexp_extract(text, r"(?im)^candidate_rows:\s*(.+)$", 1), r"\|"), lambda x: F.trim(x)), lambda x: x != "")

    def rows(width: Column, tokens: Column, amounts: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            label, after = F.get(tokens, i), F.slice(amounts, i + 2, width)
            section = label.endswith(":") & F.get(tokens, i + 1).isNotNull() & F.get(amounts, i + 1).isNull()
            good = (i >= acc["next"]) & F.get(amounts, i).isNull() & ~section & (F.size(after) == width) & F.exists(after, lambda v: v.isNotNull())
            row = F.struct(label.alias("label"), F.slice(tokens, i + 2, width).alias("vals"))
            return F.when(good, F.struct(F.concat(acc["rows"], F.array(row)).alias("rows"), (i + 1 + width).alias("next"))).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), F.struct(none.alias("rows"), F.lit(0).alias("next")), step, lambda acc: acc["rows"])

    cells = F.struct(F.size(headers(text)).alias("n"), tokens.alias("tokens"))
    told = lambda x: bind(F.struct(F.greatest(x["n"] - 1, F.lit(1)).alias("width"), F.transform(x["tokens"], amount).alias("amounts")), lambda y: rows(y["width"], x["tokens"], y["amounts"]))
    return bind(cells, lambda x: F.when((x["n"] > 0) & (F.size(x["tokens"]) > 0), told(x)).otherwise(none))


def label_key(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1)), " ")


def find_row(rows: Column, label: Column) -> Column:
    alike = lambda a, k: (a != "") & (k.contains(a) | a.contains(k))
    return bind(label_key(label), lambda k: F.get(F.filter(rows, lambda r: bind(label_key(r["label"]), lambda a: alike(a, k))), 0))


def corresponding_value(rows: Column, source: Column, target: Column, want_max: Column) -> Column:
    """'value; status' of the target row where the source row is largest (or smallest); null if either row lacks numbers."""

    def told(vals: Column, sv: Column, tv: Column) -> Column:
        whole = (F.size(sv) > 0) & (F.size(sv) == F.size(tv)) & ~F.exists(sv, lambda v: v.isNull()) & ~F.exists(tv, lambda v: v.isNull())
        at = F.array_position(sv, F.when(want_max, F.array_max(sv)).otherwise(F.array_min(sv))).cast("int") - 1

        def said(i: Column) -> Column:
            value = F.get(tv, i)
            status = F.when(value == F.array_min(tv), "minimum").when(value == F.array_max(tv), "maximum").otherwise("typical")
            return F.concat(clean_amount(F.get(vals, i)), F.lit("; "), status)

        return F.when(whole, bind(at, said))

    found = lambda r: F.struct(find_row(r, source)["vals"].alias("s"), find_row(r, target)["vals"].alias("t"))
    numbers = lambda x: F.struct(F.transform(x["s"], amount).alias("s"), F.transform(x["t"], amount).alias("t"))
    return bind(rows, lambda r: bind(found(r), lambda x: bind(numbers(x), lambda n: told(x["t"], n["s"], n["t"]))))


def corresponding_answer(question: Column, text: Column) -> Column:
    """The answer to "when 'A' was highest, what was the corresponding 'B'", from one packet's table notes."""
    asked = F.struct(F.regexp_extract_all(question, F.lit("['\"]([^'\"]+)['\"]"), F.lit(1)).alias("quoted"), F.lower(question).alias("low"))

    def told(q: Column) -> Column:
        quoted, low = q["quoted"], q["low"]
        source, target = F.get(quoted, 0), F.get(quoted, 1)
        window = F.call_function("substring_index", F.substring(low, F.greatest(F.instr(low, F.lower(source)), F.lit(1)), F.length(low)), F.lit("corresponding"), F.lit(1))
        extremes = F.struct(window.rlike(r"\b(?:maximum|highest|max)\b").alias("most"), window.rlike(r"\b(?:minimum|lowest|min)\b").alias("least"))
        return F.when(low.contains("corresponding") & (F.size(quoted) >= 2), bind(extremes, lambda e: F.when(e["most"] | e["least"], corresponding_value(table_rows(text), source, target, e["most"]))))

    return bind(asked, told)


def year_block(text: Column, year: Column) -> Column:
    """What stands after a year and before the next other year."""
    after = F.substring(text, F.instr(text, year) + 4, F.length(text))
    return F.when(F.instr(text, year) > 0, F.regexp_replace(after, r"(?s)\b20\d{2}\b.*$", ""))


def money(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(MONEY), F.lit(1)), lambda x: F.trim(x))


def repurchase_ratio(packets: DataFrame, key: str = "example_id", question: str = "question", text: str = "text", order: str = "packet_id") -> DataFrame:
    """key, answer: repurchases of the asked fiscal year divided by its dividends, each from the first packet that has it."""
    year = F.regexp_extract(F.lower(F.col(question)), r"\bfiscal\s+year\s+(20\d{2})\b", 1)
    body = year_block(F.col(text), year)
    bought = F.when(F.lower(F.col(text)).contains("repurchase"), amount(F.element_at(money(body), -1)))
    paid = F.filter(money(body), lambda v: amount(v) > 0)
    paid = F.when(F.lower(F.col(text)).contains("dividend"), amount(F.when((F.instr(F.lower(body), "(in millions)") > 0) & (F.size(paid) >= 5), F.get(paid, 4)).otherwise(F.element_at(paid, -1))))
    df = packets.where(year != "").select(key, order, bought.alias("_b"), paid.alias("_p"))
    got = df.groupBy(key).agg(F.min_by("_b", F.when(F.col("_b").isNotNull(), F.col(order))).alias("b"), F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col(order))).alias("p"))
    return got.where("b > 0 and p > 0").select(key, F.format_string("%.2f", F.col("b") / F.col("p")).alias("answer"))


def segment_percent(packets: DataFrame, key: str = "example_id", text: str = "text", order: str = "packet_id") -> DataFrame:
    """key, answer: the largest acquisition amount of a segment as a rounded share (half to even) of the total purchase price."""
    rows, heads = table_rows(F.col(text)), headers(F.col(text))
    price = F.get(F.filter(rows, lambda r: label_key(r["label"]).contains("purchase price")), 0)
    stated = F.regexp_extract(F.col(text), r"(?i)\btotal\s+purchase\s+price\b[^$\d]{0,60}(\$?\s*\d{1,3}(?:,\d{3})+)", 1)
    total = F.coalesce(amount(F.element_at(F.filter(price["vals"], lambda v: amount(v).isNotNull()), -1)), amount(stated))
    columns = F.filter(F.sequence(F.lit(0), F.greatest(F.size(heads) - 2, F.lit(0))), lambda i: F.lower(F.get(heads, i + 1)).contains("acquisition"))
    parts = F.flatten(F.transform(F.filter(rows, lambda r: ~label_key(r["label"]).isin("total", "totals")), lambda r: F.transform(columns, lambda i: amount(F.get(r["vals"], i)))))
    df = packets.select(key, order, total.alias("_t"), F.array_max(F.filter(parts, lambda v: v > 0)).alias("_s"))
    got = df.groupBy(key).agg(F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col(order))).alias("t"), F.max("_s").alias("s"))
    share = F.bround(F.col("s") / F.col("t") * 100)
    return got.where((F.col("s") > 0) & (F.col("s") < F.col("t")) & share.between(1, 99)).select(key, F.concat(share.cast("int").cast("string"), F.lit("%")).alias("answer"))


# ---- repair lines


def words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1)))


def overlap_score(line: Column, question: Column, answer: Column) -> Column:
    both = lambda a, b: F.size(F.array_intersect(words(a), words(b)))
    return F.least(F.lit(8), 2 * both(line, question)) + F.least(F.lit(4), 2 * both(line, answer))


def repair_lines(packets: DataFrame, keys: list[str], checkbox: bool = False, k: int = 6) -> DataFrame:
    """keys, packet_id, line, score, rank: the k evidence lines that fit question and answer best; cited packets weigh 3 more.

    packets: keys, packet_id, ordinal, text, question, answer, cited.
    """
    df = packets.select(*keys, "packet_id", "ordinal", "question", "answer", "cited", F.posexplode(lines_of(F.col("text"))).alias("_i", "line"))
    box = F.col("line").rlike(r"(?i)\[x\]|☒|☑|✓|\bcheck(?:ed|box)?\b") if checkbox else F.lit(False)
    cue = (F.size(F.array_intersect(words(F.col("line")), words(F.col("question")))) > 0) | (F.size(F.array_intersect(words(F.col("line")), words(F.col("answer")))) > 0)
    score = overlap_score(F.col("line"), F.col("question"), F.col("answer")) + F.when(F.col("cited"), 3).otherwise(0) + F.when(box, 6).otherwise(0) + F.when(F.col("line").rlike(r"\d"), 1).otherwise(0)
    df = df.where(cue | box).withColumn("score", score).where("score > 0")
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "ordinal", "_i")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "packet_id", "line", "score", "rank")


def shortest_ranges(months: Column) -> Column:
    """[{months, first, last}] between neighbouring month numbers, shortest first."""
    pairs = F.zip_with(F.slice(months, F.lit(1), F.greatest(F.size(months) - 1, F.lit(0))), F.slice(months, F.lit(2), F.greatest(F.size(months) - 1, F.lit(0))), lambda a, b: F.struct(F.abs(b - a).alias("months"), a.alias("first"), b.alias("last")))
    return F.array_sort(F.filter(pairs, lambda p: p["months"] > 0))


# ---- retries


def strongest_attempt(attempts: Column) -> Column:
    """Of unsupported attempts [{answer, n_citations, confidence}] in order the one to keep.

    A later attempt replaces the kept one if it answers where that did not, cites where that did not, or is more confident;
    opposite booleans need 0.15 more, and a longer text that only repeats a concise answer never replaces it at similar confidence.
    """
    gone = lambda a: F.lower(F.trim(F.coalesce(a["answer"], F.lit("")))).isin("", "unanswerable", "unknown")
    truth = lambda a: F.regexp_extract(F.lower(F.trim(a["answer"])), r"^(yes|no|true|false)\b", 1)
    opposite = lambda a, b: (truth(a) != "") & (truth(b) != "") & (truth(a).isin("yes", "true") != truth(b).isin("yes", "true"))
    concise = lambda a: (F.length(a["answer"]) <= 40) & ~a["answer"].contains(";")
    extends = lambda a, b: (F.length(a["answer"]) > F.length(b["answer"])) & F.lower(a["answer"]).contains(F.lower(b["answer"]))

    def better(new: Column, old: Column) -> Column:
        more = new["confidence"] - old["confidence"]
        return (
            F.when(gone(new) & ~gone(old), False)
            .when(gone(old) & ~gone(new), True)
            .when((new["n_citations"] > 0) & (old["n_citations"] == 0), True)
            .when((old["n_citations"] > 0) & (new["n_citations"] == 0), False)
            .when(concise(old) & extends(new, old) & (more <= 0.15), False)
            .when(concise(new) & extends(old, new) & (new["n_citations"] == old["n_citations"]) & (more >= -0.15), True)
            .when(opposite(new, old), more > 0.15)
            .otherwise(more > 0)
        )

    return F.aggregate(F.slice(attempts, F.lit(2), F.greatest(F.size(attempts) - 1, F.lit(0))), F.get(attempts, 0), lambda old, new: F.when(better(new, old), new).otherwise(old))


def focused_packets(packets: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """Target packets of a retry, with up to n cited packets of their pages and up to n uncited visual ones, nearest first.

    packets: keys, packet_id, page, x0..y1, region_type, cited, target, ordinal.
    """
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    goal = packets.where("target").groupBy(*keys, "page").agg(F.avg(cx).alias("_tx"), F.avg(cy).alias("_ty"))
    near = packets.where(~F.col("target")).join(goal, [*keys, "page"])
    cited = near.where("cited").withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal")))
    gap = F.sqrt((cx - F.col("_tx")) ** 2 + (cy - F.col("_ty")) ** 2)
    seen = near.where(~F.col("cited") & F.col("region_type").isin(*VISUAL_TYPES)).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round(gap, 9), "packet_id")))
    pick = lambda df, why: df.where(F.col("_r") <= n).select(*keys, "packet_id", F.lit(why).alias("why"))
    return packets.where("target").select(*keys, "packet_id", F.lit("target").alias("why")).union(pick(cited, "cited")).union(pick(seen, "visual"))


def event_ids(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """events with event_id '<stage>.<type>.<k>': a counter for each stage and type of a trace."""
    k = F.row_number().over(Window.partitionBy(*keys, "stage", "event_type").orderBy(*order))
    return events.withColumn("event_id", F.concat_ws(".", "stage", "event_type", k.cast("string")))


def tile_size(example_id: Column) -> Column:
    """2, 4 or 8 with weights 1/4, 1/2 and 1/4, from the id's hash: reproducible without a sequential generator."""
    u = F.conv(F.substring(F.sha2(example_id, 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.when(u < 0.25, 2).when(u < 0.75, 4).otherwise(8)


def noise_pages(pages: DataFrame, gold: DataFrame, keys: list[str], page: str, n: int, seed: int) -> DataFrame:
    """n pages of each document that are no gold pages, by hash order."""
    rest = pages.join(gold, [*keys, page], "left_anti")
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.lit(seed), *keys, page)), page)
    return rest.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
