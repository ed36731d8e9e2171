"""Text of evidence packets cut to what a question or an answer is about: lines that share words, with their neighbours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shapes import bind

# Words that say nothing, and character limits of snippets.
STOP_WORDS = ("the", "and", "of", "in", "to", "is", "are", "was", "were", "for", "on", "at", "by", "an", "as", "it", "or", "be", "which", "what", "this", "that", "with", "from", "does", "do", "how")
SNIPPET_CHARS, VERIFIER_CHARS, CONTEXT_CHARS = 600, 1600, 240
TEXT_ONLY_ROLES = ("page-header", "page-footer", "section-header", "title", "header", "footer")
CHART_NAMES = ("VOUT", "VIN", "TIME")
PER_DIVISION = r"(?i)\b([A-Z][A-Z0-9_ ]{0,24}?)\s*[(=:]?\s*([+-]?\d+(?:\.\d+)?)\s*(mV|V|uV|µV|nV|us|µs|ms|s|ns)\s*/\s*div\b"


def focus_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def match_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def lines_at(lines: Column, at: Column, before: int, after: int) -> Column:
    """The lines at these places and around them, in order, each once."""
    near = F.flatten(F.transform(at, lambda i: F.sequence(i - before, i + after)))
    kept = F.array_sort(F.array_distinct(F.filter(near, lambda i: (i >= 0) & (i < F.size(lines)))))
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), " / ")


def question_lines(text: Column, question: Column, limit: int = SNIPPET_CHARS, best: int = 3) -> Column:
    """A text over the limit cut to the lines that share most words with the question (or one less), with the lines next to them."""

    def choose(x: Column) -> Column:
        lines, asked = x["lines"], x["asked"]
        scored = F.transform(lines, lambda line, i: F.struct((-F.size(F.array_intersect(focus_words(line), asked))).alias("s"), i.alias("i")))
        most = -F.array_min(F.transform(scored, lambda r: r["s"]))
        top = F.slice(F.array_sort(F.filter(scored, lambda r: -r["s"] >= F.greatest(F.lit(1), most - 1))), 1, best)
        return F.when(most > 0, lines_at(lines, F.transform(top, lambda r: r["i"]), 1, 1))

    short = F.length(text) <= limit
    found = bind(F.struct(lines_of(text).alias("lines"), focus_words(question).alias("asked")), choose)
    return F.when(short | (F.size(focus_words(question)) == 0), text).otherwise(F.coalesce(found, text))


def answer_lines(text: Column, answer: Column) -> Column:
    """The lines that hold the answer, one before and two after each; the search ends once twelve places are taken."""

    def choose(x: Column) -> Column:
        lines, words, whole = x["lines"], x["words"], x["whole"]
        holds = F.transform(lines, lambda line: match_text(line).contains(whole) | (F.size(F.array_except(words, focus_words(line))) == 0))
        start = F.array().cast("array<int>")
        places = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0))), start, lambda acc, i: F.when((F.size(acc) < 12) & F.coalesce(F.get(holds, i), F.lit(False)), F.array_union(acc, F.sequence(i - 1, i + 2))).otherwise(acc))
        return lines_at(lines, places, 0, 0)

    gone = F.coalesce(F.lower(F.trim(answer)).isin("", "unanswerable"), F.lit(True)) | (F.size(focus_words(answer)) == 0)
    found = bind(F.struct(lines_of(text).alias("lines"), focus_words(answer).alias("words"), match_text(answer).alias("whole")), choose)
    return F.when(gone, "").otherwise(F.coalesce(found, F.lit("")))


def focused_text(text: Column, question: Column, answer: Column, limit: int = VERIFIER_CHARS) -> Column:
    """The answer's lines first, then the question's."""

    def join(x: Column) -> Column:
        a, q = x["a"], x["q"]
        return F.when(a == "", q).when((q == "") | (q == x["t"]) | a.contains(q), a).otherwise(F.concat_ws(" / ", a, q))

    return bind(F.struct(answer_lines(text, answer).alias("a"), question_lines(text, question, limit, 4).alias("q"), text.alias("t")), join)


def snippet(text_layer: Column, ocr: Column, question: Column, limit: int = SNIPPET_CHARS) -> Column:
    """One line of a packet's text, or of its OCR, about the question."""
    whole = F.coalesce(F.when(text_layer != "", text_layer), ocr, F.lit(""))
    t = F.trim(F.regexp_replace(question_lines(whole, question, limit), r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def neighbour_roles(refs: Column, roles: Column, told_roles: Column) -> Column:
    """{image, text}: roles of linked crops to send as images, and those whose text is already told."""
    pairs = F.filter(F.transform(refs, lambda r, i: F.struct(r.alias("ref"), F.coalesce(F.get(roles, i), F.lit("unknown")).alias("role"))), lambda p: p["ref"] != "")
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), "_", "-")
    told = lambda p: plain(p["role"]).isin(*TEXT_ONLY_ROLES) & F.array_contains(F.transform(told_roles, plain), plain(p["role"]))
    names = lambda ps: F.transform(ps, lambda p: p["role"])
    return F.struct(names(F.filter(pairs, lambda p: ~told(p))).alias("image"), names(F.filter(pairs, told)).alias("text"))


def quoted_context(text: Column, limit: int = CONTEXT_CHARS) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.concat(F.lit("'"), F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))).otherwise(t), F.lit("'"))


def proposed_answer(text: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?im)^proposed answer:\s*(.+)$", 1))


# ---- charts


def chart_name(c: Column) -> Column:
    """A label in capitals, or the known name that it holds in any of its spellings."""
    t = F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_+ -]", "")))
    for wrong, right in (("VOUR", "VOUT"), ("VINY", "VIN"), ("V_OUT", "VOUT"), ("V OUT", "VOUT"), ("V_IN", "VIN"), ("V IN", "VIN")):
        t = F.regexp_replace(t, wrong, right)
    return bind(t, lambda x: F.coalesce(*[F.when(x.contains(n), n) for n in CHART_NAMES], x))


def asked_chart_name(question: Column) -> Column:
    return bind(chart_name(question), lambda x: F.when(x.isin(*CHART_NAMES), x))


def chart_scales(ocr: Column, question: Column) -> Column:
    """What OCR tells of scales per division, as one sentence (and which one is asked for); null without any."""
    found = F.regexp_extract_all(F.coalesce(ocr, F.lit("")), F.lit("(" + PER_DIVISION + ")"), F.lit(1))
    part = lambda m, k: F.regexp_extract(m, PER_DIVISION, k)
    unit = lambda m: F.translate(part(m, 3), "µ", "u")
    name = lambda m: chart_name(F.regexp_replace(F.translate(part(m, 1), "_", " "), r"\s+", " "))
    hints = F.transform(found, lambda m: F.struct(name(m).alias("name"), F.concat(name(m), F.lit("="), part(m, 2), unit(m), F.lit("/div")).alias("hint")))

    def tell(x: Column) -> Column:
        first = F.slice(F.array_distinct(F.transform(x["h"], lambda h: h["hint"])), 1, 4)
        own = F.get(F.filter(x["h"], lambda h: h["name"] == x["q"]), 0)
        asked = F.when(own.isNotNull(), F.concat(F.lit(" Question target scale: "), own["hint"], F.lit("."))).otherwise("")
        return F.when(F.size(first) > 0, F.concat(F.lit("Detected chart scales: "), F.array_join(first, "; "), F.lit("."), asked))

    return bind(F.struct(hints.alias("h"), asked_chart_name(question).alias("q")), tell)


def normal_tokens(c: Column) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    for wrong, right in (("v_out", "vout"), ("v out", "vout"), ("v-output", "vout"), ("vour", "vout"), ("v_in", "vin"), ("v in", "vin"), ("viny", "vin"), ("millivolts", "mv"), ("millivolt", "mv")):
        t = F.regexp_replace(t, wrong, right)
    return focus_words(F.regexp_replace(t, r"(\d)\s*mv\b", "$1 mv"))


def packet_overlap(question: Column, text: Column, chart_csv: Column) -> Column:
    """Shared words of question and packet, two more where the packet has a table of its chart."""
    shared = F.size(F.array_intersect(normal_tokens(question), normal_tokens(F.concat_ws(" ", text, chart_csv))))
    some = (F.size(normal_tokens(question)) > 0) & (F.size(normal_tokens(F.concat_ws(" ", text, chart_csv))) > 0)
    return F.when(some, shared + F.when(F.coalesce(chart_csv, F.lit("")) != "", 2).otherwise(0)).otherwise(0)
