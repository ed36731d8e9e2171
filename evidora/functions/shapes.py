"""Answer-shape repairs, decided by the kinds of an answer's tokens.

An answer is cut into tokens once. Each token has a one-letter kind (number, code, word, status, sign, ...), and the letters in
order are the answer's outline: "12.5 mA (note)" has the outline "Nw(w)". A repair looks at the outline, at single tokens and at
the words of the question, never at the raw text as a whole; it gives a new text or null, and the first that gives one decides.

Everything is one Column: the parsed answer is bound once by a one-element transform, so no token is found twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that decide what a token or a question is.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
YES, NO = ("yes", "true"), ("no", "false")
SCALES = ("million", "billion", "thousand")
STATUS = {"typical": "typical", "middle": "typical", "minimum": "minimum", "lowest": "minimum", "smallest": "minimum", "min": "minimum", "maximum": "maximum", "highest": "maximum", "largest": "maximum", "max": "maximum", "typ": "typical"}
UNITS = {"current": ("a", "ma", "ua", "µa"), "voltage": ("v", "mv", "uv", "µv"), "volt": ("v", "mv", "uv", "µv"), "percent": ("%",), "percentage": ("%",), "rate": ("%",), "ratio": ("%",), "energy": ("j", "mj", "uj", "µj")}
FILE_TYPES, SIZE_UNITS = ("bin", "elf", "fw", "hex", "img"), ("b", "byte", "bytes", "kb", "kib", "mb", "mib", "gb", "gib")
ENTITY_NOUNS = ("class", "country", "company", "entity", "region", "line", "series", "label", "row", "variable", "parameter")
DIFFERENCE_WORDS = ("difference", "minus", "subtract", "delta", "change")
MISREAD_WORDS = ("incorrect", "misinterpret", "misinterprets", "misinterpreted", "without")
PLURAL_WORDS = ("both", "two", "three", "all", "tie", "tied")
ROUGHLY = ("about", "approximately", "around", "roughly")
EXPLAINING_HEADS = ("the", "this", "that", "it", "in", "using", "from", "based", "because", "as", "where", "which")
EXPLAINING_WORDS = ("legend", "axis", "chart", "coefficient", "footnote", "checkbox", "checked", "figure", "table", "row", "compared")
CHART_WORDS = ("table", "chart", "figure", "region", "update", "axis", "legend", "caption", "because", "show", "shows", "indicate", "indicates")
RESERVED = ("reserved", "raz", "sbz", "res0")
RESET_ZERO, UNDEFINED_EXCEPTION, INPUT_MODES = "0 (reset value)", "Undefined exception", {"fully": "Fully-differential input mode", "pseudo": "Pseudo-differential input mode"}

#: What counts as one token, most special first.
TOKEN = (
    r"([0Oo][xX][0-9A-Fa-f]+(?![A-Za-z0-9])"  # hexadecimal
    r"|[A-Za-z0-9_-]+\.(?:" + "|".join(FILE_TYPES) + r")(?![A-Za-z0-9])"  # file name
    r"|\d+(?:,\d{3})*(?:\.\d+)*"  # number, or numbers of a section
    r"|[A-Za-z_µμ][A-Za-z0-9_µμ]*"  # word or code
    r"|\S)"  # sign
)
WORD = "[wLKIS]"


class Answer:
    """A parsed answer: columns of its text, question, tokens, gaps before them, and outline."""

    def __init__(self, bound: Column):
        self.text, self.question, self.tokens, self.gaps, self.outline, self.asked_words, self.finance = (bound[c] for c in ("text", "question", "tokens", "gaps", "outline", "asked_words", "finance"))

    def fits(self, outline: str) -> Column:
        return self.outline.rlike(f"^(?:{outline})$")

    def token(self, i: int | Column) -> Column:
        """Token i from 0, from the end if negative."""
        return F.try_element_at(self.tokens, F.lit(i if i < 0 else i + 1) if isinstance(i, int) else i + 1)

    def low(self, i: int | Column) -> Column:
        return F.lower(self.token(i))

    def length_of(self, outline: str) -> Column:
        """How many tokens, from the first, an outline's start takes."""
        return F.length(F.regexp_extract(self.outline, f"^(?:{outline})", 0))

    def part(self, first: int | Column, count: int | Column) -> Column:
        """The text of so many tokens from first on, with the spaces between them."""
        first, count = (F.lit(x) if isinstance(x, int) else x for x in (first, count))
        own = F.zip_with(F.slice(self.gaps, first + 1, count), F.slice(self.tokens, first + 1, count), lambda g, t: F.concat(g, t))
        return strip(F.array_join(own, ""))

    def asks(self, *words: str) -> Column:
        return F.arrays_overlap(self.asked_words, F.array(*[F.lit(w) for w in words]))

    def asks_which(self, nouns: tuple[str, ...], within: int = 5) -> Column:
        """'which' and one of the nouns among the next words."""
        among = F.array(*[F.lit(n) for n in nouns])
        return F.exists(F.sequence(F.lit(1), F.greatest(F.size(self.asked_words), F.lit(1))), lambda i: (F.try_element_at(self.asked_words, i) == "which") & F.arrays_overlap(F.slice(self.asked_words, i + 1, F.lit(within)), among))

    def phrase(self, *words: str) -> Column:
        """Whether the question holds these words one after another."""
        return F.concat(F.lit(" "), F.array_join(self.asked_words, " "), F.lit(" ")).contains(f" {' '.join(words)} ")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value found once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def one_of(c: Column, words) -> Column:
    return c.isin(*words)


def kind(t: Column) -> Column:
    """The letter of a token."""
    low = F.lower(t)
    return (
        F.when(t.rlike(r"^[0Oo][xX][0-9A-Fa-f]+$"), "X")
        .when(t.rlike(r"\.(?:" + "|".join(FILE_TYPES) + ")$"), "F")
        .when(t.rlike(r"^\d[\d,]*(?:\.\d+)?$"), "N")
        .when(t.rlike(r"^\d"), "R")
        .when(t.rlike(r"^b[01x]{3,16}$"), "B")
        .when(one_of(low, MONTHS), "M")
        .when(one_of(low, STATUS), "S")
        .when(one_of(low, SCALES), "Z")
        .when(t.rlike(r"^[A-Z]$"), "I")
        .when(t.rlike(r"^[A-Z][A-Z0-9_]+$|^[A-Za-z_]+\d[A-Za-z0-9_]*$"), "K")
        .when(t.rlike(r"^[A-Z]"), "L")
        .when(t.rlike(r"^[A-Za-z_µμ]"), "w")
        .when(t.isin("–", "—", "−"), "-")
        .otherwise(t)
    )


def parse(text: Column, question: Column, finance: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))
    words = F.regexp_extract_all(F.lower(question), F.lit(r"([a-z0-9_]+)"), F.lit(1))
    return F.struct(text.alias("text"), question.alias("question"), tokens.alias("tokens"), F.split(text, TOKEN, -1).alias("gaps"), F.array_join(F.transform(tokens, kind), "").alias("outline"), words.alias("asked_words"), finance.alias("finance"))


def concise(c: Column) -> Column:
    """Short enough to be an answer by itself: 1 to 8 words, at most 90 characters."""
    return (c != "") & (F.length(c) <= 90) & F.size(F.filter(F.split(c, r"[^A-Za-z0-9_.$%+-]+"), lambda x: x != "")).between(1, 8)


def with_unit(value: Column, unit: Column) -> Column:
    return F.when(unit == "%", F.concat(value, unit)).when(unit != "", F.concat_ws(" ", value, unit)).otherwise(value)


def scalar(a: Answer, first: Column) -> Column:
    """The value at token first: an optional sign, a number and an optional unit of at most ten letters."""
    signed = a.token(first).isin("+", "-", "−")
    at = first + signed.cast("int")
    unit = F.coalesce(a.token(at + 1), F.lit(""))
    unit = F.when(unit.rlike(r"^(?:%|[A-Za-zµμ]{1,10})$"), unit).otherwise("")
    return with_unit(F.concat(F.when(signed, F.regexp_replace(a.token(first), "−", "-")).otherwise(""), a.token(at)), unit)


def money(a: Answer, first: int | Column, outline: Column) -> Column:
    """The amount in tokens that spell '$', parentheses, sign, number and '%': parentheses are a minus."""
    count = F.length(outline)
    raw = F.regexp_replace(a.part(first, count), r"[\s$()]", "")
    return F.when(outline.contains("("), F.concat(F.lit("-"), raw)).otherwise(raw)


MONEY = r"\$?(?:\([-+]?N\)|[-+]?N)%?"


def status(word: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.lower(word))


# ---- repairs by type


def boolean(a: Answer) -> Column:
    """yes or no from the first word, also after 'the answer is'."""
    lead = (a.low(0) == "the") & (a.low(1) == "answer") & (a.low(2) == "is")
    first = F.when(F.coalesce(lead, F.lit(False)), a.low(3)).otherwise(a.low(0))
    return F.when(one_of(first, YES), "yes").when(one_of(first, NO), "no")


def accounting(a: Answer) -> Column:
    """'(1,234) million' is -1234; an amount in parentheses alone stays."""
    head = r"\$?\([-+]?N\)"
    n = a.length_of(head)
    follows = a.outline.rlike(f"^{head}Z") | ((n > 0) & (F.try_element_at(a.gaps, n + 1) == "") & a.token(n).rlike(r"^\w"))
    return F.when(follows, F.concat(F.lit("-"), F.regexp_replace(a.part(0, n), r"[\s$(),]", "")))


def difference(a: Answer) -> Column:
    """What stands after the last '=' where a difference is asked for or written out."""
    tail = r"=[-+]?N(?:%|[wLKI])?"
    at = F.length(a.outline) - F.length(F.regexp_extract(a.outline, f"({tail})$", 1)) + 1
    written = a.outline.rlike(f"[KS].*-.*[KS].*{tail}$")
    return F.when(a.outline.rlike(f"{tail}$") & (a.asks(*DIFFERENCE_WORDS) | written), scalar(a, at))


def noted_scalar(a: Answer) -> Column:
    """A value before a note in parentheses, or before what it is not."""
    value = r"[-+]?N(?:%|[wLKI])?"
    n = a.length_of(r"[-+]?N(?:%|[wLKI](?=\())?")
    noted = a.fits(value + r"\([^()]+\)") & (F.length(a.text) <= 100)
    plain = a.length_of(r"[-+]?N(?:%)?")
    contrast = lambda at: ((a.low(at) == "not") | ((a.low(at) == "instead") & (a.low(at + 1) == "of")) | ((a.low(at) == "rather") & (a.low(at + 1) == "than"))) & a.outline.rlike(r"[-+]?N(?:%|[wLKI])?$")
    bare, unit = contrast(plain), contrast(plain + 1)
    fits = a.fits(value + r"ww?[-+]?N(?:%|[wLKI])?")
    cut = lambda k: F.regexp_replace(with_unit(F.regexp_replace(a.part(0, plain), r"\s", ""), F.when(k > plain, a.token(plain)).otherwise("")), "−", "-")
    return F.when(noted, cut(n)).when(fits & F.coalesce(bare, F.lit(False)), cut(plain)).when(fits & F.coalesce(unit, F.lit(False)), cut(plain + 1))


def embedded_scalar(a: Answer) -> Column:
    """The last value whose unit the question hints at; else the only value of a text of over 40 characters."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a.tokens) - 1, F.lit(0))), lambda i: (F.substring(a.outline, i + 1, F.lit(1)) == "N") & F.coalesce(a.token(i + 1).rlike(r"^(?:%|[A-Za-zµμ]{1,8})$"), F.lit(False)))
    hints = F.coalesce(*[F.when(F.array_contains(a.asked_words, w), F.array(*[F.lit(u) for u in us])) for w, us in UNITS.items()])
    fit = F.filter(places, lambda i: F.array_contains(hints, F.translate(F.lower(a.token(i + 1)), "μ", "µ")))
    signed = lambda i: F.when((i > 0) & a.token(i - 1).isin("+", "-", "−") & ((i == 1) | F.coalesce(F.try_element_at(a.gaps, i) != "", F.lit(True))), i - 1).otherwise(i)
    best = F.when(hints.isNotNull() & (F.size(fit) > 0), F.try_element_at(fit, F.lit(-1))).when((F.size(places) == 1) & (F.length(a.text) > 40), F.get(places, 0))
    return bind(bind(best, lambda i: F.when(i.isNotNull(), signed(i))), lambda i: F.when(i.isNotNull(), scalar(a, i)))


def reset_zero(a: Answer) -> Column:
    return F.when(a.asks("reset") & a.fits("X") & a.token(0).rlike("^0[xX]0+$"), RESET_ZERO)


def hex_address(a: Answer) -> Column:
    """A padded address without its leading zeros."""
    padded = a.fits("X") & a.token(0).rlike("^0x00*[0-9A-Fa-f]{4}") & (F.substring(a.token(0), 3, 1) == "0")
    digits = F.ltrim(F.upper(F.substring(a.token(0), 3, 64)), F.lit("0"))
    return F.when(a.asks("address", "hexadecimal") & padded, F.concat(F.lit("0x"), F.when(digits == "", "0").otherwise(digits)))


def hex_value(a: Answer) -> Column:
    """The only hexadecimal number, in upper case, with its note in parentheses; a register of an endian form keeps its name."""
    at = F.instr(a.outline, "X") - 1
    only = F.length(F.regexp_replace(a.outline, "[^X]", "")) == 1
    digits = F.concat(F.lit("0x"), F.upper(F.substring(a.token(at), 3, 64)))
    endian = a.outline.rlike(r"^[wL]-?[wL][KIL]=X(?:[,;.].*)?$") & one_of(a.low(0), ("little", "big")) & a.text.rlike("(?i)^[a-z]+[- ]endian")
    labelled = (at == 0) | a.outline.rlike("[;:]X")
    note = F.regexp_extract(a.outline, r"X(\([^()]*\))?(?:[,;.].*)?$", 1)
    whole = a.outline.rlike(r"X(?:\([^()]*\))?(?:[,;.].*)?$")
    # a closing letter O is a zero where a sibling in the note ends in a digit
    names = F.slice(a.tokens, at + 2, F.length(note))
    mended = F.transform(names, lambda t: F.when(t.rlike("^[A-Za-z]\\w*[Oo]$") & F.exists(names, lambda s: F.lower(s).rlike(r"\d$") & (F.regexp_replace(F.lower(s), r"\d+$", "") == F.lower(F.regexp_replace(t, "[Oo]$", "")))), F.regexp_replace(t, "[Oo]$", "0")).otherwise(t))
    spelled = F.array_join(F.zip_with(F.slice(a.gaps, at + 2, F.length(note)), mended, lambda g, t: F.concat(g, t)), "")
    return F.when(only & endian, F.concat(a.token(F.instr(a.outline, "=") - 2), F.lit("= "), digits)).when(only & whole & labelled, F.concat(digits, F.when(note != "", spelled).otherwise("")))


def min_typ_max(a: Answer) -> Column:
    """Three values in the order minimum, typical, maximum, in one form."""
    value = r"[:=]?[-+]?N(?:%|[wLKI])?"
    marks = F.transform(F.filter(a.tokens, lambda t: F.lower(t).isin(*STATUS)), status)
    fits = a.fits(rf"S{value}[,;/]?S{value}[,;/]?S{value}") & (F.array_join(marks, " ") == "minimum typical maximum")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a.tokens) - 1, F.lit(0))), lambda i: F.substring(a.outline, i + 1, F.lit(1)) == "S")
    after = lambda k: F.get(starts, k) + 1 + a.token(F.get(starts, k) + 1).isin(":", "=").cast("int")

    def value_at(k: int) -> Column:
        at = after(k)
        unit_at = at + 1 + a.token(at).isin("+", "-", "−").cast("int")
        bare = with_unit(a.token(unit_at - 1), F.when(F.substring(a.outline, unit_at + 1, F.lit(1)).rlike("[%wLKI]"), a.token(unit_at)).otherwise(""))
        return F.concat(F.when(unit_at > at + 1, a.token(at)).otherwise(""), F.regexp_replace(bare, "%$", " %"))

    return F.when(fits, F.concat(F.lit("min: "), value_at(0), F.lit(", typ: "), value_at(1), F.lit(", max: "), value_at(2)))


def leading_entity(a: Answer) -> Column:
    """'Label, about 12 ...' is the label where the question asks which one."""
    own = a.outline.rlike(r"^(?:I\.)?[LKIw][^,]*,")
    first = F.when(a.outline.rlike(r"^I\."), 2).otherwise(0)
    comma = F.instr(a.outline, ",") - 1
    label = a.part(first, comma - first)
    value = F.substring(a.outline, comma + 2, F.lit(1)).rlike(r"[N$+-]") | one_of(a.low(comma + 1), ROUGHLY)
    dated = F.substring(a.outline, first + 1, comma - first).contains("M")
    return F.when(own & value & ~dated & a.asks_which(ENTITY_NOUNS) & concise(label), label)


def first_of_pair(a: Answer) -> Column:
    """'A and B ...' is A where one entity is asked for."""
    at = F.array_position(F.transform(a.tokens, F.lower), "and").cast("int") - 1
    first = F.when(a.outline.rlike(r"^I\."), 2).otherwise(0)
    stop = F.regexp_extract(F.substring(a.outline, at + 2, F.length(a.outline)), r"^([^,;:]*)", 1)
    left, right = a.part(first, at - first), a.part(at + 1, F.length(stop))
    plain = ~F.substring(a.outline, first + 1, at - first).rlike(r"[^LKIwNS&/.'-]") & F.substring(a.outline, first + 1, F.lit(1)).rlike(WORD) & F.substring(a.outline, at + 2, F.lit(1)).rlike(WORD)
    return F.when((at > first) & plain & a.asks_which(ENTITY_NOUNS) & ~a.asks(*PLURAL_WORDS) & concise(left) & concise(right), left)


def value_status(a: Answer) -> Column:
    """'value; status' from a bare pair, from a sentence on the corresponding value, or from the only such pair inside."""
    head = F.regexp_extract(a.outline, rf"^({MONEY})[,;/w]w?S$", 1)
    joined = a.low(F.length(head)).isin(",", ";", "/", "and") & ((F.length(a.outline) == F.length(head) + 2) | (a.low(F.length(head) + 1) == "the"))
    pair = lambda at, outline, word: F.concat(money(a, at, outline), F.lit("; "), status(word))
    bare = F.when((head != "") & joined, pair(F.lit(0), head, a.token(-1)))
    # a sentence: the value after 'corresponding ... is|was|=' and the status that follows it
    at = F.array_position(F.transform(a.tokens, F.lower), "corresponding").cast("int")
    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a.tokens), F.lit(1))), lambda i: (i > at) & a.low(i - 1).isin("is", "was", "equal", "equals", "=") & F.substring(a.outline, i + 1, F.lit(8)).rlike(f"^{MONEY}"))
    spot = F.get(spots, 0)
    amount = F.regexp_extract(F.substring(a.outline, spot + 1, F.lit(8)), f"^({MONEY})", 1)
    later = F.regexp_extract(F.substring(a.outline, spot + 1 + F.length(amount), F.lit(60)), r"^([^.?!S]*)S", 1)
    has_later = F.substring(a.outline, spot + 1 + F.length(amount), F.lit(60)).rlike(r"^[^.?!S]*S")
    told = F.when((at > 0) & spot.isNotNull() & has_later, pair(spot, amount, a.token(spot + F.length(amount) + F.length(later))))
    # exactly one value that reads as an amount, then at most 12 tokens and a status
    link = r"(?:\([^()]{1,12}\))?(?:[,;/-]|w)[^.?!S]{0,12}S"
    inline = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a.tokens) - 1, F.lit(0))), lambda i: F.substring(a.outline, i + 1, F.lit(40)).rlike(f"^{MONEY}{link}") & ~F.coalesce(a.token(i - 1).isin("$", "(", "-", "+", "−"), F.lit(False)) & linked(a, i))
    i = F.get(inline, 0)
    inner = F.regexp_extract(F.substring(a.outline, i + 1, F.lit(40)), f"^({MONEY}){link}", 1)
    whole = F.length(F.regexp_extract(F.substring(a.outline, i + 1, F.lit(40)), f"^{MONEY}{link}", 0))
    single = F.when((F.size(inline) == 1) & a.part(i, F.length(inner)).rlike(r"[,.%]"), pair(i, inner, a.token(i + whole - 1)))
    return F.coalesce(bare, told, single)


def linked(a: Answer, i: Column) -> Column:
    """Whether what follows the value at i is a separator or a form of 'to be'."""
    n = F.length(F.regexp_extract(F.substring(a.outline, i + 1, F.lit(40)), rf"^{MONEY}(?:\([^()]{{1,12}}\))?", 0))
    return F.coalesce(a.low(i + n).isin(",", ";", "/", "-", "–", "—", "is", "was", "were", "which"), F.lit(False))


def file_size(a: Answer) -> Column:
    """'file, size' without an explanation behind it."""
    own = a.outline.rlike("^F[,;]N[wLKI](?:[,;].*)?$") & one_of(a.low(3), SIZE_UNITS)
    tail = F.coalesce(a.low(5), F.lit(""))
    explains = (F.length(a.outline) == 4) | (tail == "state") | ((a.token(4) == ";") & tail.isin("the", "this", "these", "that", "after", "following", "because", "as", "which", "where"))
    return F.when(own & explains, F.concat(a.token(0), F.lit(", "), a.part(2, 2)))


def assignment(a: Answer) -> Column:
    """'VAR=5V' as 'VAR = 5 V'."""
    value = F.concat(F.when(a.token(2).isin("-", "−"), "-").otherwise(""), F.try_element_at(a.tokens, F.lit(-2)))
    return F.when(a.fits("[LKIw]=-?N(?:%|[wLKI])") & (F.length(a.token(0)) <= 13) & (F.length(a.token(-1)) <= 6), F.concat(a.token(0), F.lit(" = "), value, F.lit(" "), a.token(-1)))


# ---- repairs of exact answers that read the question


def page_number(a: Answer) -> Column:
    """Answers to 'which page': a leading page, a label with its page, the page after a quoted target, or a closing page."""
    asked = a.phrase("page", "number") | a.phrase("which", "page") | a.phrase("what", "page")
    referred = a.phrase("same", "page") | a.phrase("page", "reference") | a.phrase("refer", "to")
    digits = lambda c: c.rlike(r"^\d{2,5}$")
    leading = a.outline.rlike(r"^N[;,:-].|^Nw[R]") & digits(a.token(0)) & (a.outline.rlike(r"^N[;,:-]") | (a.low(1) == "and"))
    named = a.outline.rlike(r"^.+,w[NLKIwRX]$") & (a.low(-2) == "page")
    labelled = a.outline.rlike(r"^[LKIw][^,;]*,[NLKIwRX]$") & (F.length(a.text) > 4)
    n = F.size(a.tokens)
    targets = F.filter(F.split(a.question, "'"), lambda x, i: (i % 2 == 1) & F.length(x).between(3, 80))
    after = lambda t: F.regexp_extract(F.element_at(F.split(F.lower(a.text), F.concat(F.lit(r"\Q"), F.lower(t), F.lit(r"\E"))), -1), r"^\D{0,80}(\d{3,5})", 1)
    quoted = F.get(F.filter(F.transform(F.filter(targets, lambda t: F.lower(a.text).contains(F.lower(t))), after), lambda x: x != ""), 0)
    closing = a.outline.rlike(r"^(?:R)?[LKIw][LKIwSNR()/_-]*N$") & a.token(-1).rlike(r"^\d{3,5}$") & (n > 1)
    return F.when(
        asked,
        F.when(leading, a.token(0)).when(named & referred, F.concat(a.part(0, n - 3), F.lit("; page "), a.token(-1))).when(labelled, F.concat(a.part(0, n - 2), F.lit(", page "), a.token(-1))).when(quoted.isNotNull() & (a.phrase("page", "number") | a.phrase("which", "page") | a.phrase("refer", "to")), quoted).when(closing, a.token(-1)),
    )


def binary_code(a: Answer) -> Column:
    """The only binary code of a short text."""
    at = F.instr(a.outline, "B") - 1
    ranges = F.size(F.split(a.outline, r"\[")) - 1
    one = F.length(F.regexp_replace(a.outline, "[^B]", "")) == 1
    return F.when(a.asks("setting", "code", "value", "bit", "bits") & one & (ranges <= 1) & (F.size(F.split(a.text, " ")) <= 6), a.token(at))


def percent_points(a: Answer) -> Column:
    return F.when(a.asks(*MISREAD_WORDS) & a.fits("[-+]?Nw") & (a.low(-1) == "ppt"), F.concat(a.part(0, F.size(a.tokens) - 1), F.lit("%")))


def undefined_exception(a: Answer) -> Column:
    return F.when(a.asks("exception", "result") & F.lower(a.text).rlike(r"\bundefined exception\b"), UNDEFINED_EXCEPTION)


def first_by_priority(a: Answer) -> Column:
    """The first entry of a ranked list: '1 A; 2 B' or 'A, 1; B, 2'."""
    asked = a.phrase("handled", "first") | a.asks("priority")
    numbered = a.outline.rlike(r"^N[^N;]+(?:;|w)N.")
    stop = F.length(F.regexp_extract(a.outline, r"^N([^N;]+?)(?:;|w)N", 1))
    joined = (a.token(stop + 1) == ";") | (a.low(stop + 1) == "and")
    paired = a.outline.rlike(r"^[LKIw][^;,]*,N;[LKIw][^;,]*,N")
    return F.when(asked & numbered & F.coalesce(joined, F.lit(False)), a.part(1, stop)).when(asked & paired, a.part(0, F.instr(a.outline, ",") - 1))


def bits_of_reserved(a: Answer) -> Column:
    """'[7:4], Reserved' is the bits."""
    n = a.length_of(r"\[[N:,]+\]")
    word = F.when(a.token(n).isin(",", "-", "–", "—") | (a.low(n) == "and"), a.low(n + 1))
    return F.when((n > 0) & one_of(word, RESERVED), a.part(0, n))


def repeated_identifier(a: Answer) -> Column:
    """'X and ... by X' is X."""
    own = (a.low(1) == "and") & (a.low(-2) == "by") & (a.token(0) == a.token(-1)) & (F.size(a.tokens) > 4)
    return F.when(own & a.token(0).rlike(r"^[A-Za-z_]\w{3,80}$"), a.token(0))


def input_mode(a: Answer) -> Column:
    mode = lambda m: F.lower(a.text).rlike(rf"\b{m}[- ]+differential\b")
    return F.when(a.phrase("input", "mode"), F.when(mode("fully"), INPUT_MODES["fully"]).when(mode("pseudo"), INPUT_MODES["pseudo"]))


def single_field(a: Answer) -> Column:
    """'A; B' is A where one field is asked for; of fields next to another, the first code listed."""
    asked = a.asks_which(("field",), 3)
    codes = F.filter(a.tokens, lambda t: t.rlike(r"^[A-Z][A-Z0-9_]{1,20}$"))
    listed = a.outline.contains(",") | F.array_contains(F.transform(a.tokens, F.lower), "and")
    adjacent = a.phrase("immediately", "adjacent") | a.phrase("lower", "bit", "side")
    return F.when(asked & a.fits("[LKIw];[LKIw]"), a.token(0)).when(asked & adjacent & listed & ~a.outline.contains(";") & (F.size(codes) >= 2), F.get(codes, 0))


def method_unit(a: Answer) -> Column:
    """'method and unit' as 'method(), unit'."""
    n = a.length_of(r"[LKIw](?:\(\))?")
    fits = a.fits(r"[LKIw](?:\(\))?(?:,|w)[wLKI%]") & ((a.token(n) == ",") | (a.low(n) == "and")) & (F.length(a.token(-1)) <= 8)
    return F.when(a.asks("method", "api", "function") & a.asks("unit") & fits, F.concat(a.token(0), F.lit("(), "), a.token(-1)))


def entity_value(a: Answer) -> Column:
    """'Entity [and] value' as 'Entity, value'; 'status; TICKER' is the ticker."""
    n = F.size(a.tokens)
    value = F.regexp_extract(a.outline, "(-?N%?)$", 1)
    at = n - F.length(value)
    joined = a.low(at - 1) == "and"
    stop = at - F.coalesce(joined, F.lit(False)).cast("int")
    names = F.substring(a.outline, F.lit(1), stop)
    label = a.part(0, stop)
    pair = (value != "") & names.rlike(r"^[LKI][LKIwSM .'-]*$") & ~F.lower(label).isin(*MONTHS) & ~label.rlike(r"^(?:[A-Z]?\W*)$") & (F.length(label) > 1)
    ticker = a.outline.rlike("^S[;:,]K") & a.token(2).rlike("^[A-Z]{1,6}$")
    return F.when(pair, F.concat(label, F.lit(", "), F.regexp_replace(a.part(at, F.length(value)), r"\s", ""))).when(ticker, a.token(2))


def quoted_class(a: Answer) -> Column:
    """The quoted class of 'the registrant is a "..."'."""
    asked = a.asks("classification", "checkbox", "checkmark", "checkmarks") | a.phrase("check", "mark") | a.phrase("check", "marks")
    inside = F.get(F.split(a.text, '"'), 1)
    before = F.regexp_replace(F.lower(F.substring_index(a.text, '"', 1)), r"\s+(?:a|an|the)?\s*$", "")
    return F.when(asked & before.rlike(r"(?:registrant|company|entity) is$") & F.length(inside).between(3, 80) & (F.size(F.split(a.text, '"')) > 2), inside)


def option(a: Answer) -> Column:
    """The one of the question's options in parentheses that the text names; of several, the one that its end calls extreme."""
    body = F.regexp_extract(a.question, r"\(([^()]{8,240})\)", 1)
    parts = F.transform(F.split(F.regexp_replace(body, r"(?i)\s+or\s+", ","), ","), lambda x: F.regexp_replace(x, r"^[\s.;:'\"]+|[\s.;:'\"]+$", ""))
    options = F.filter(parts, lambda x: (x != "") & (F.size(F.split(x, r"\s+")) <= 8))
    low = F.lower(a.text)
    present = F.when(F.size(parts) > 1, F.filter(options, lambda x: low.contains(F.lower(x))))
    written = lambda x: F.substring(a.text, F.length(a.text) - F.instr(F.reverse(low), F.reverse(F.lower(x))) - F.length(x) + 2, F.length(x))
    # sentences of the closing 240 characters that hold an extreme word and exactly this option
    clauses = F.split(F.lower(F.substring(a.text, -240, 240)), r"[.?!]")
    extreme = r"\b(?:largest|highest|smallest|lowest|most|least|correct|answer)\b"
    told = F.get(F.filter(present, lambda x: F.exists(clauses, lambda c: c.rlike(extreme) & c.contains(F.lower(x)) & (F.size(F.filter(present, lambda y: c.contains(F.lower(y)))) == 1))), 0)
    only = F.get(present, 0)
    label = one_of(F.lower(only), STATUS) & a.outline.contains("N")
    return F.when((F.size(present) == 1) & ~label, written(only)).when((F.size(present) > 1) & told.isNotNull(), written(told))


def variable_option(a: Answer) -> Column:
    """Of the last 'A or B' of a question on variables the one that the text names, reading l and 1 as I; current first for output power."""
    pairs = F.regexp_extract_all(a.question, F.lit(r"\b([A-Z][A-Z0-9_]+ ?(?:or|/|-+|—) ?[A-Z][A-Z0-9_]+)\b"), F.lit(1))
    sides = F.split(F.try_element_at(pairs, F.lit(-1)), r" ?(?:\bor\b|/|—|-+) ?")
    own = F.transform(a.tokens, lambda t: F.regexp_replace(F.upper(t), "^[L1](?=[A-Z]{2})", "I"))
    numbers_joined = F.regexp_replace(F.upper(a.text), r"\b[L1](?=(?:OUT|IN|LOAD|RECT)\b)", "I")
    present = F.filter(sides, lambda x: F.array_contains(own, x) | F.array_contains(F.split(numbers_joined, r"\W+"), x))
    current = F.filter(present, lambda x: x.startswith("I") | x.contains("CURRENT"))
    power = a.phrase("output", "power") | a.phrase("out", "terminal")
    return F.when(a.asks("which") & a.asks("variable", "axis") & (F.size(pairs) > 0), F.when(F.size(present) == 1, F.get(present, 0)).when(power & (F.size(current) == 1), F.get(current, 0)))


def before_explanation(a: Answer) -> Column:
    """A code label before words on a chart, a panel's label, or the concise part before an explaining ';'."""
    comma = F.instr(a.outline, ",") - 1
    code = F.substring(a.outline, F.lit(1), comma).rlike("^[KI][KIN]+$") & F.arrays_overlap(F.transform(F.slice(a.tokens, comma + 2, F.size(a.tokens)), F.lower), F.array(*[F.lit(w) for w in CHART_WORDS]))
    joined = F.regexp_replace(a.part(0, comma), r"(?<=[A-Z]) (?=\d)", "")
    panel = a.outline.rlike(r"^I\.")
    stop = F.length(F.regexp_extract(a.outline, r"^I\.([^,.;-]+)[,.;-]", 1))
    after = a.low(stop + 3)
    cut = (F.try_element_at(a.tokens, stop + 3) != ",") | one_of(after, (*ROUGHLY, "determined", "based", "because", "from", "using", "which", "where")) | after.rlike(r"^[-$\d]")
    label = a.part(2, stop)
    semi = F.instr(a.outline, ";") - 1
    head = a.part(F.when(panel, 2).otherwise(0), semi - F.when(panel, 2).otherwise(0))
    tail = F.transform(F.slice(a.tokens, semi + 2, F.size(a.tokens)), F.lower)
    explains = one_of(F.get(tail, 0), EXPLAINING_HEADS) | F.arrays_overlap(tail, F.array(*[F.lit(w) for w in EXPLAINING_WORDS])) | F.lower(F.substring_index(a.text, ";", -1)).contains(F.lower(head))
    return F.when((comma > 0) & code, F.regexp_replace(joined, r"\s+", "_")).when(panel & (stop > 0) & cut & concise(label), label).when((semi > 0) & concise(head) & F.coalesce(explains, F.lit(False)), head)


def leading_part(a: Answer) -> Column:
    """'Head: tail' or 'Head - tail' is a concise head, unless it is a status or begins as a sentence does."""
    n = F.length(F.regexp_extract(a.outline, r"^([^:.;-]+)[:.-]", 1))
    spaced = F.when(a.token(n).isin(":", "."), F.coalesce(F.try_element_at(a.gaps, n + 2) != "", F.lit(False))).otherwise(F.try_element_at(a.gaps, n + 1) != "")
    head = a.part(0, n)
    plain = ~one_of(a.low(0), ("using", "from", "based", "the", "a", "an")) & ~a.outline.rlike("^S[:.-]")
    return F.when(a.asks("which", "what") | a.phrase("based", "on"), F.when((n > 0) & (F.size(a.tokens) > n + 1) & spaced & plain & F.length(head).between(2, 80) & concise(head), head))


def person_name(a: Answer) -> Column:
    """'First Last - explanation' is the name."""
    n = F.length(F.regexp_extract(a.outline, "^(L{2,4})-", 1))
    return F.when((n > 0) & (F.try_element_at(a.gaps, n + 1) != "") & (F.size(a.tokens) > n + 1), a.part(0, n))


def code_identifier(a: Answer) -> Column:
    """'ABC 12. explanation' is 'ABC_12'."""
    told = F.regexp_extract(a.outline, r"^((?:[KI](?:[-_]?[KIN])*))[.;].", 1)
    alone = F.regexp_extract(a.outline, r"^([KI](?:[-_]?K)+)$", 1)
    code = F.when(told != "", told).otherwise(alone)
    name = a.part(0, F.length(code))
    spaced = (told == "") | F.coalesce(F.try_element_at(a.gaps, F.length(code) + 2) != "", F.lit(False))
    return F.when((code != "") & spaced & name.rlike(r"\d"), F.regexp_replace(name, "[ -]+", "_"))


def page_reference(a: Answer) -> Column:
    """'X on page N' as 'X; page N'."""
    n = F.size(a.tokens)
    return F.when((a.low(-2) == "page") & (a.low(-3) == "on") & (n > 3), F.concat(a.part(0, n - 3), F.lit("; page "), a.token(-1)))


def bit_assignments(text: Column) -> Column:
    """'[7:4]=b0001, [3]=1' from a text that is nothing but such assignments; other texts stay."""
    pieces = F.transform(F.filter(F.split(text, r"[,;]\s*(?=\[)|\s+(?=\[)"), lambda x: x != ""), lambda x: F.regexp_replace(x, r"\s*(?:=|:(?![0-9]+\])|\bis\b)\s*", "="))
    good = F.forall(pieces, lambda x: x.rlike(r"^\[\d+(?::\d+)?\]=(?:0x|b)?[0-9A-Fa-fx]+$"))
    return F.when((F.size(pieces) >= 2) & good, F.array_join(F.transform(pieces, lambda x: F.concat(F.substring_index(x, "=", 1), F.lit("="), F.lower(F.substring_index(x, "=", -1)))), ", ")).otherwise(text)


Repair = Callable[[Answer], Column]
#: Repairs in the order in which they are tried, by type and domain; those for exact answers that read the question, besides.
NUMERIC: tuple[Repair, ...] = (difference, noted_scalar, embedded_scalar)
ANY_VALUE: tuple[Repair, ...] = (hex_value, min_typ_max)
QUESTION: tuple[Repair, ...] = (page_number, binary_code, percent_points, reset_zero, hex_address, undefined_exception, first_by_priority, bits_of_reserved, repeated_identifier, input_mode, single_field, method_unit)
QUESTION_LAST: tuple[Repair, ...] = (quoted_class, option, variable_option, before_explanation, leading_part)


def first_that_fits(repairs: tuple[Repair, ...], a: Answer) -> Column:
    return F.coalesce(*[r(a) for r in repairs])


def normalise(text: Column, kind_: Column, domain: Column, question: Column) -> Column:
    """text must be free of repeated white space; kind_ is the stem of the answer type, domain in lower case."""
    finance = domain.contains("finance")

    def decide(bound: Column) -> Column:
        a = Answer(bound)
        num, exact = kind_ == "numeric", kind_ == "exact_match"
        return F.coalesce(
            F.when(kind_ == "boolean", boolean(a)),
            F.when(num & a.finance, accounting(a)),
            F.when(num, first_that_fits(NUMERIC, a)),
            F.when(exact, first_that_fits((reset_zero, hex_address), a)),
            F.when(exact | num, first_that_fits(ANY_VALUE, a)),
            F.when(exact & a.finance, first_that_fits((leading_entity, first_of_pair, value_status), a)),
            F.when(exact & domain.contains("datasheet"), file_size(a)),
            F.when(exact | num, assignment(a)),
            F.when(exact & (question != ""), F.coalesce(first_that_fits(QUESTION, a), F.when(a.finance, entity_value(a)), first_that_fits(QUESTION_LAST, a))),
            F.when(exact & a.finance, person_name(a)),
            F.when(exact, first_that_fits((code_identifier, page_reference), a)),
            a.text,
        )

    return bind(parse(text, question, finance), decide)
