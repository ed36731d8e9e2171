"""Row-level policies of an evaluation: what a question asks for, what an answer looks like, when to retry, expand or stop.

Questions are read by their words (`contracts.Question`), answers by their outline of token kinds (`shapes`). All are Columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import shapes
from .contracts import Question, contract_failures

# Families, types, words and thresholds of the policies.
ENTITY_WORDS = ("country", "company", "entity", "parameter", "region", "line", "series", "label", "row", "column", "value", "variable")
NAMED_WORDS = ("class", "country", "company", "entity", "region", "line", "series", "label", "row", "variable", "parameter")
ESTIMATE_WORDS, ESTIMATED = ("estimate", "approximately", "approximate", "rounded", "nearest"), ("ratio", "width", "height", "visible", "border", "borders", "curve", "axis", "chart", "figure")
CHART_WORDS, READING_WORDS = ("chart", "figure", "curve", "axis", "caption", "plot", "graph"), ("what", "which", "read", "allowed", "at", "ambient", "temperature", "dissipation", "voltage", "current")
CALCULATION_WORDS = ("calculate", "calculation", "compute", "computed", "formula", "equation", "divider")
MOVE_WORDS, SPAN_WORDS = ("decline", "increase", "fall", "rise", "dropped", "fastest", "steepest"), ("period", "from", "to", "between")
SHORT_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UNANSWERABLE = ("", "unanswerable", "unknown", "cannot determine", "can't determine")
STOP_WORDS = ("the", "and", "of", "in", "to", "is", "are", "was", "were", "for", "on", "at", "by", "an", "which", "what")
CONFIDENCE_MARGIN, TIE_MARGIN, VARIABLE_MARGIN, SURE = 0.15, 0.05, 0.25, 0.85
FINE_DETAIL_FAMILIES = ("axis_value_interpolation", "confusable_label", "direct_label_reading", "legend_series_binding", "min_typ_max_disambiguation")
CAP_EXEMPT_FAMILIES = ("axis_value_interpolation", "chart_caption_fusion", "chart_footnote_fusion", "chart_table_cross_ref", "curve_axis_reading", "dual_axis_disambiguation", "legend_series_binding", "multi_chart_comparison", "timing_diagram_reading")
STRUCTURED_FAMILIES = ("min_typ_max_disambiguation", "table_note_fusion", "condition_footnote_fusion", "near_miss_distractor", "confusable_label", "chart_table_cross_ref")
STRUCTURED_WORDS = ("among", "checkbox", "checkmark", "compare", "condition", "corresponding", "highest", "lowest", "min", "minimum", "max", "maximum", "row", "typ", "typical")
VISUAL_FAMILIES = ("chart_caption_fusion", "curve_axis_reading", "direct_label_reading", "legend_series_binding", "multi_chart_comparison", "timing_diagram_reading")
BROAD_FAMILIES, BROAD_PACKETS, BROAD_RELEVANCE = ("legend_series_binding", "multi_chart_comparison"), 2, 0.65
CONTEXT_ROLES = ("legend_binding", "axis_reading", "caption_context", "footnote_adjustment", "table_cell_lookup", "header_disambiguation")
CHART_CLASSES = ("bar_chart", "line_chart", "candlestick")
PANEL_TYPES, PANEL_AREA = ("chart", "curve", "diagram", "figure", "image", "line_chart", "picture", "plot"), 0.20
PANEL_WORDS = ("gridline", "gridlines", "oscilloscope", "panel", "timing", "trace", "transition", "waveform", "waveforms")
UNION_WORDS = ("disconnect", "disconnected", "fragment", "fragmented", "fragments", "unclear", "garbled", "illegible")
UNION_PHRASES = ("full diagram", "full figure", "full context", "larger crop", "larger context", "larger view", "surrounding context", "surrounding diagram", "surrounding figure", "too small", "not enough context")
THROTTLE_MARKERS = ("429", "resource_exhausted", "rate limit", "rate_limit", "too many requests", "quota")
QUOTA_MARKERS = ("quota exceeded", "current quota", "free_tier", "free tier", "requests per day", "generaterequestsperday", "generate_content_free_tier_requests")
PROTOCOLS = {"focus": ("focus_default", "agentic_multi_page"), "react": ("full_doc", "oracle_page", "oracle_crop", "agentic_multi_page"), "simple": ("full_doc", "oracle_page", "oracle_crop", "tiled_2up", "tiled_4up")}


def text_of(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def words_say(c: Column, words: tuple[str, ...] = (), phrases: tuple[str, ...] = ()) -> Column:
    q = Question(F.coalesce(c, F.lit("")))
    return q.has(*words) | q.says(*phrases) if words and phrases else q.has(*words) if words else q.says(*phrases)


def read(answer: Column, use) -> Column:
    """use(parsed answer), parsed once."""
    return shapes.bind(shapes.parse(text_of(answer), F.lit(""), F.lit(False)), lambda b: use(shapes.Answer(b)))


# ---- what a question asks for


def asks_single_entity(question: Column) -> Column:
    q = Question(F.coalesce(question, F.lit("")))
    owned = F.exists(F.sequence(F.lit(1), F.greatest(F.size(q.words), F.lit(1))), lambda i: F.coalesce((F.try_element_at(q.words, i) == "which") & F.try_element_at(q.words, i + 1).endswith("'s"), F.lit(False)))
    return q.near(("which",), ENTITY_WORDS, 4) | owned


def asks_named_entity(question: Column) -> Column:
    return Question(F.coalesce(question, F.lit(""))).near(("which",), NAMED_WORDS, 6)


def asks_variable(question: Column) -> Column:
    return words_say(question, ("variable",), ("y axis", "x axis"))


def asks_estimate(question: Column) -> Column:
    return words_say(question, ESTIMATE_WORDS) & words_say(question, ESTIMATED)


def asks_chart_reading(question: Column) -> Column:
    return words_say(question, CHART_WORDS) & words_say(question, READING_WORDS)


def asks_calculation(question: Column) -> Column:
    return words_say(question, CALCULATION_WORDS, ("show your",))


def asks_period(question: Column) -> Column:
    return words_say(question, phrases=("which period", "date range", "time period")) | (words_say(question, MOVE_WORDS) & words_say(question, SPAN_WORDS))


def entity_margin(question: Column) -> Column:
    """How much more confident a retry must be to replace a named entity."""
    return F.when(words_say(question, ("variable", "parameter"), ("y axis", "x axis")), VARIABLE_MARGIN).otherwise(CONFIDENCE_MARGIN)


# ---- what an answer looks like


def looks_unanswerable(answer: Column) -> Column:
    return F.lower(text_of(answer)).isin(*UNANSWERABLE)


def boolean_value(answer: Column) -> Column:
    t = F.regexp_replace(F.lower(text_of(answer)), r"^[ .,:;]+|[ .,:;]+$", "")
    return F.when(t.isin("yes", "true"), True).when(t.isin("no", "false"), False)


def opposite_booleans(a: Column, b: Column) -> Column:
    return F.coalesce(boolean_value(a) != boolean_value(b), F.lit(False))


def selection_words(c: Column) -> Column:
    """The distinct telling words of an answer or question."""
    found = F.regexp_extract_all(F.translate(F.lower(F.coalesce(c, F.lit(""))), "µ", "u"), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def question_overlap(answer: Column, question: Column) -> Column:
    return F.size(F.array_intersect(selection_words(answer), selection_words(question)))


def is_concise(answer: Column) -> Column:
    return ~looks_unanswerable(answer) & (F.length(text_of(answer)) <= 80) & (F.size(selection_words(answer)) <= 6)


def is_formula(answer: Column) -> Column:
    return F.coalesce(answer.contains("=") & (answer.rlike("[+*/()]") | words_say(answer, ("eff", "loss", "offset"))), F.lit(False))


def is_scalar(answer: Column) -> Column:
    return read(answer, lambda a: a.fits("[-+]?N(?:%|[wLKI])?") & (F.length(F.regexp_replace(a.text, r"[^A-Za-zµμ%]", "")) <= 8))


def starts_with_scalar(answer: Column) -> Column:
    return read(answer, lambda a: a.outline.rlike("^[-+]?N"))


def decimal_places(answer: Column) -> Column:
    first = F.get(F.filter(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda x: x != ""), 0)
    return F.coalesce(F.when(first.contains("."), F.length(F.substring_index(first, ".", -1))), F.lit(0))


def _months(a: shapes.Answer) -> Column:
    """Places of 'Month[,] YYYY' in a parsed answer."""
    month = lambda i: F.coalesce(F.lower(F.substring(F.try_element_at(a.tokens, i), 1, 3)).isin(*SHORT_MONTHS) & F.try_element_at(a.tokens, i).rlike("^[A-Za-z]{3,9}$"), F.lit(False))
    year = lambda i: F.coalesce(F.try_element_at(a.tokens, i).rlike(r"^\d{4}$"), F.lit(False))
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(a.tokens), F.lit(1))), lambda i: month(i) & (year(i + 1) | ((F.try_element_at(a.tokens, i + 1) == ",") & year(i + 2))))


def is_single_date(answer: Column) -> Column:
    return read(answer, lambda a: (F.size(_months(a)) == 1) & (F.get(_months(a), 0) == 1) & (F.size(a.tokens) <= 3))


def is_date_range(answer: Column) -> Column:
    joined = lambda a: F.exists(a.tokens, lambda t: F.lower(t).isin("to", "through", "-", "–", "—"))
    return read(answer, lambda a: (F.size(_months(a)) >= 2) & joined(a))


def is_numeric_surrogate(answer: Column) -> Column:
    """A number with a status word, or a number alone: a stand-in for a name."""
    status = words_say(answer, ("min", "minimum", "max", "maximum", "typ", "typical", "score", "percentage", "point", "points"))
    return ~looks_unanswerable(answer) & ((text_of(answer).rlike(r"\d") & status) | read(answer, lambda a: a.fits("[-+]?N%?")))


def same_shape_scalars(a: Column, b: Column) -> Column:
    number = lambda c: read(c, lambda x: x.fits("[-+]?N(?:%|[wLKI])?"))
    one = (F.size(selection_words(a)) == 1) & (F.size(selection_words(b)) == 1)
    return is_concise(a) & is_concise(b) & F.when(number(a) | number(b), number(a) & number(b)).otherwise(one)


def is_list(answer: Column) -> Column:
    t = F.lower(text_of(answer))
    return (t != "") & (t.rlike("[;,]") | words_say(answer, ("and", "or")) | (F.size(selection_words(answer)) > 3))


def canonical_span(answer: Column) -> Column:
    t = F.regexp_replace(F.lower(text_of(answer)), r"^[a-e]\.\s+", "")
    t = F.translate(F.regexp_replace(t, "[\"'“”‘’]", ""), "_µ", " u")
    return F.trim(F.regexp_replace(t, "[^a-z0-9.%+-]+", " "))


def contains_span(candidate: Column, initial: Column) -> Column:
    c, i = canonical_span(candidate), canonical_span(initial)
    return (c != "") & (i != "") & c.contains(i)


def explains_after(candidate: Column, initial: Column) -> Column:
    """Whether the candidate is the initial text and an explanation behind a separator."""
    c, i = text_of(candidate), text_of(initial)
    rest = F.substring(c, F.length(i) + 1, F.length(c))
    return (i != "") & c.startswith(i) & rest.rlike(r"^\s*(?:(?:[,;:]|[-–—])\s+\S|\(\S)")


def is_verbose_context(answer: Column) -> Column:
    return words_say(answer, ("figure", "table", "row", "caption", "legend", "axis", "compared", "because", "using", "shows", "indicates", "verified", "confirm"))


def normal_answer(c: Column) -> Column:
    return F.regexp_replace(F.lower(text_of(c)), r"\s+", " ")


def is_verbose_extension(candidate: Column, incumbent: Column) -> Column:
    c, i = text_of(candidate), text_of(incumbent)
    longer = (F.length(c) >= F.length(i) + 12) | (F.size(selection_words(c)) >= F.size(selection_words(i)) + 2) | explains_after(c, i)
    return contains_span(c, i) & (normal_answer(c) != normal_answer(i)) & longer


def adds_required_fields(candidate: Column, question: Column) -> Column:
    """Whether a longer retry completes what the question asks for."""
    q = Question(F.coalesce(question, F.lit("")))
    three = q.says("min typ max", "minimum typical maximum", "min typical max")
    all_three = reduce(lambda a, b: a & b, [words_say(candidate, w) for w in (("min", "minimum"), ("typ", "typical"), ("max", "maximum"))])
    return F.when(three, all_three).otherwise(q.has("both", "two", "three", "all") & F.coalesce(candidate.rlike(r"(?i)\s(?:and|;)\s"), F.lit(False)))


# ---- retries


def keeps_initial_answer(initial: Column, candidate: Column, question: Column, contract: dict[str, Column], retries: Column) -> Column:
    """Whether a concise cited answer is kept although a supported retry gave another that looks worse.

    initial and candidate: structs of answer, citations (array) and confidence.
    """
    a, b = initial["answer"], candidate["answer"]
    more = F.coalesce(candidate["confidence"], F.lit(0.0)) - F.coalesce(initial["confidence"], F.lit(0.0))
    shared = (F.size(candidate["citations"]) == 0) | F.arrays_overlap(initial["citations"], candidate["citations"])
    fa, fb = F.size(contract_failures(a, contract)), F.size(contract_failures(b, contract))
    considered = (
        (retries > 0) & (F.size(initial["citations"]) > 0) & ~looks_unanswerable(a) & (normal_answer(a) != normal_answer(b)) & shared
        & ~((fa > 0) & (fb < fa)) & (more <= CONFIDENCE_MARGIN) & is_concise(a)
    )
    stable = same_shape_scalars(a, b) & (initial["confidence"] >= SURE) & (more <= TIE_MARGIN) & asks_chart_reading(question) & ~asks_calculation(question)
    much_longer = (F.length(text_of(b)) >= F.length(text_of(a)) + 35) | (F.size(selection_words(b)) >= F.size(selection_words(a)) + 4)
    repeats = (contains_span(b, a) | normal_answer(b).contains(normal_answer(a))) & (much_longer | explains_after(b, a))
    worse = stable | looks_unanswerable(b) | (is_formula(b) & ~is_formula(a)) | repeats | (much_longer & (is_list(b) | is_verbose_context(b)))
    return F.coalesce(considered & worse, F.lit(False))


def uses_tool_inspector(budget: Column, family: Column, top_relevance: Column) -> Column:
    """Hard cases: tiny regions, or a fine-detail question whose best region is weak."""
    return (F.trim(F.coalesce(budget, F.lit(""))) == "highres_tiny") | (F.trim(F.coalesce(family, F.lit(""))).isin(*FINE_DETAIL_FAMILIES) & F.coalesce(top_relevance < 0.5, F.lit(False)))


def directed(reason: Column, targeted: Column) -> Column:
    """Whether a verifier has named what to look at."""
    return (text_of(reason) != "") & F.coalesce(targeted, F.lit(False))


def expands_at_first(has_primary: Column, needed_for: Column, n_hints: Column, relevance: Column, reranked: Column, reason: Column, targeted: Column, threshold: float = 0.5) -> Column:
    """Whether a packet gets context in the first pass: always without a reranker's word, else where it speaks for the region."""
    free = (text_of(reason) != "") | F.coalesce(targeted, F.lit(False)) | ~reranked | ~has_primary
    spoken = F.coalesce(needed_for.isin("primary", *CONTEXT_ROLES), F.lit(False)) | (F.coalesce(n_hints, F.lit(0)) > 0) | F.coalesce(relevance >= threshold, F.lit(False))
    return free | spoken


def caps_first_expansion(family: Column, reranked: Column, reason: Column, targeted: Column) -> Column:
    return reranked & (text_of(reason) == "") & ~F.coalesce(targeted, F.lit(False)) & ~F.coalesce(family, F.lit("")).isin(*CAP_EXEMPT_FAMILIES)


def adds_union_context(reason: Column, targeted: Column, n_targets: Column, most_on_a_page: Column) -> Column:
    """Whether a retry gets a crop around several target packets of one page."""
    return directed(reason, targeted) & (n_targets >= 2) & (most_on_a_page >= 2) & words_say(reason, UNION_WORDS, UNION_PHRASES)


def adds_panels(reason: Column, targeted: Column, region_type: Column, area: Column) -> Column:
    return directed(reason, targeted) & words_say(reason, PANEL_WORDS, ("actual visual", "text alone", "visual content")) & F.lower(text_of(region_type)).isin(*PANEL_TYPES) & (area >= PANEL_AREA)


def is_chart(figure: Column) -> Column:
    return F.coalesce(figure, F.lit("")).isin(*CHART_CLASSES)


def wants_structure(family: Column, evidence_types: Column, question: Column) -> Column:
    return F.coalesce(family, F.lit("")).isin(*STRUCTURED_FAMILIES) | F.array_contains(evidence_types, "checkbox") | words_say(question, STRUCTURED_WORDS, ("check mark", "part number", "visually similar"))


def needs_visual_context(family: Column) -> Column:
    return F.coalesce(family, F.lit("")).isin(*VISUAL_FAMILIES)


def allows_context_crop(family: Column, needed_for: Column, relevance: Column, packet_index: Column) -> Column:
    good = (needed_for == "primary") | relevance.isNull() | (relevance >= BROAD_RELEVANCE)
    return ~F.coalesce(family, F.lit("")).isin(*BROAD_FAMILIES) | ((packet_index < BROAD_PACKETS) & F.coalesce(good, F.lit(False)))


# ---- errors and runs


def says_any(c: Column, markers: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(m) for m in markers])


def is_throttle(error: Column) -> Column:
    return says_any(error, THROTTLE_MARKERS)


def is_quota_exhausted(error: Column) -> Column:
    return says_any(error, QUOTA_MARKERS)


def aborts_run(error: Column, strict_layout: Column) -> Column:
    """Errors that would spoil a whole run: throttling, and layout failures where they are not tolerated."""
    return is_throttle(error) | (strict_layout & says_any(error, ("layoutendpointunavailable", "stubresponseerror")))


def is_stub_layout(n_boxes: Column, box_area: Column, page_area: Column) -> Column:
    """A layout response that is one box over the whole page."""
    return (n_boxes == 1) & (page_area > 0) & (F.try_divide(box_area, page_area) >= 0.95)


def protocol_fits(agent: Column, protocol: Column) -> Column:
    return F.when(agent == "focus", protocol.isin(*PROTOCOLS["focus"])).when(agent.isin("react", "agent_baseline"), protocol.isin(*PROTOCOLS["react"])).otherwise(protocol.isin(*PROTOCOLS["simple"]))
