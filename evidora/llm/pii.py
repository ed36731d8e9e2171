"""PII: detected entities get keyed surrogates of the same type, format, script and gender.

Native: DataFrame functions only.

1. Lines that hold a digit, an '@' or a title are searched for entities; other lines cost one scan for these characters. Card numbers
   count only with a valid Luhn digit, IBANs only with valid check digits.
2. The distinct entities of the corpus, counted on the map side, get their surrogates in a table of their own. One entity is
   replaced alike in every document, in whatever case or spacing it is written. A name is replaced word by word: a given name by
   one of the gender that its title states, a surname by one surrogate whatever stands before it.
3. Collision checks on that table: where two of a type share a surrogate, or a surrogate is itself an entity of the corpus, later
   ones are redrawn with the next attempt until none collide.
4. Each distinct text with entities gets the map of its own, by a content key, and only such texts are shuffled to meet theirs;
   the others pass by. Coreference: where a text names a person by title, the words of that name are replaced in all of the text,
   also without a title ("Mr. John Smith ... John ... Smith's").

Surrogates are functions of (key, type, canonical form, attempt). Digit strings pass a keyed Feistel network over their digits,
which is a bijection for each length, so phone, card and social security numbers and IP addresses stay distinct by construction;
emails, secrets and names are drawn by hash. Whoever has the key can undo the network: the caller gives it, and there is no default.

Format: each digit, lower-case and upper-case letter is replaced by one of its kind, separators stay; cards keep a valid Luhn digit,
IBANs their country and valid check digits, API keys their prefix; names keep title, number of parts and script (Latin, Greek or
Cyrillic). The '+' country code stays. Names and emails grow with the attempts, so they never run out; a fixed format of which
the corpus uses all values raises.

Defined results: a null text stays null with no entities; empty texts stay; a text of any length is searched whole; repeated rows
are replaced alike; of two surrogates that a word has in one text (as given name and as surname) the smaller is used; an empty table
stays empty; other columns, whatever their names, pass through unchanged. An entity lies within one line.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stage

_TITLE_F = r"Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora|Doña|Κα|Г-жа|г-жа|Госпожа"
_TITLE_M = r"Mr|Herr|Monsieur|Sr|Señor|Don|Κος|Г-н|г-н|Господин"
_CAP = r"(?:\p{Lu}[\p{Ll}'’]+)(?:-\p{Lu}\p{Ll}+)?"

#: (type, pattern), tried in this order at each place. No capturing groups.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,64}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}|(?:sk|pk|rk)[-_][0-9A-Za-z_-]{20,}|xox[abeoprs]-[0-9A-Za-z-]{10,})(?![0-9A-Za-z])"),
    ("email", r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z][0-9A-Za-z._%+-]*@(?:[0-9A-Za-z](?:[0-9A-Za-z-]*[0-9A-Za-z])?\.)+[A-Za-z]{2,24}(?![0-9A-Za-z])|[^\s@|\"'<>(),;:!?*#&$%]+@(?:[0-9A-Za-z](?:[0-9A-Za-z-]*[0-9A-Za-z])?\.)+[A-Za-z]{2,24}(?![0-9A-Za-z])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("ipv6", r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("name", rf"(?<![\p{{L}}])(?:{_TITLE_F}|{_TITLE_M})\.? {_CAP}(?: {_CAP}){{0,2}}"),
)
ENTITY = "|".join(p for _, p in PATTERNS)
#: What a line must hold to be searched: titles by their first letters, so that most places fail on one character.
GATE = r"[0-9@]|[MFSDΚГг](?:rs?|s|iss|rau|me|adame|ra|eñora|oña|onsieur|eñor|on|α|ος|-жа|-н|оспожа|осподин)\.? \p{Lu}|Herr\.? \p{Lu}"

#: Syllables for names by script, and the endings that mark a gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta".split(),
    "greek": "βα βε βο δα δε δο φα φε γα γο κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та".split(),
}
ENDINGS = {"latin": {"f": "lia", "m": "rek", "": "nis"}, "greek": {"f": "λια", "m": "ρεκος", "": "νις"}, "cyrillic": {"f": "лия", "m": "рек", "": "нис"}}
#: What stands before the random part of an API key.
SECRET_PREFIX = r"^(?:A[KS]IA|gh[pousr]_|eyJ|(?:sk|pk|rk)[-_]|xox[abeoprs]-)"
ROUNDS = 4
#: Rounds of redrawing without progress after which a fixed format counts as full.
PATIENCE = 40


@dataclass(frozen=True)
class Surrogates:
    """key: the secret that keys all surrogates. Without it they can't be told from other keys' surrogates, nor be undone."""

    key: str

    def __post_init__(self):
        if not self.key:
            raise ValueError("surrogates need a secret key")


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting spark.evidora.pii.key, or a new random one that nobody keeps."""
    return spark.conf.get("spark.evidora.pii.key", None) or secrets.token_hex(32)


def luhn_sum(digits: Column, first_doubled: int) -> Column:
    """Luhn sum of a digit string from its right end, doubling every second digit from position first_doubled (0 or 1) on."""
    value = lambda c, i: F.when(i % 2 == first_doubled, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda acc, x: acc + x)


def mod_97(text: Column) -> Column:
    """The number that an IBAN's digits and letters (A = 10 to Z = 35) spell, modulo 97."""
    values = F.transform(F.split(text, ""), lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda acc, x: (acc * F.when(x > 9, 100).otherwise(10) + x) % 97)


def entity_type(e: Column) -> Column:
    """The first type whose whole pattern an entity fits; null if its check digits are wrong."""
    out = None
    for name, pattern in PATTERNS:
        cond = e.rlike(rf"^(?:{pattern})$")
        out = F.when(cond, name) if out is None else out.when(cond, name)
    kind = out.otherwise("email")
    plain = F.regexp_replace(e, " ", "")
    card = luhn_sum(F.regexp_replace(e, r"[^0-9]", ""), 1) % 10 == 0
    iban = mod_97(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))) == 1
    return F.when(((kind == "card") & ~card) | ((kind == "iban") & ~iban), None).otherwise(kind)


def canonical(e: Column, kind: Column) -> Column:
    """What two writings of one entity share."""
    digits = F.regexp_replace(e, r"[^0-9]", "")
    named = F.regexp_replace(F.regexp_replace(e, r"\.? ", " "), r"\s+", " ")
    return F.when(kind.isin("phone", "ssn", "card"), digits).when(kind == "name", named).when(kind == "iban", F.regexp_replace(e, " ", "")).when((kind == "secret") & ~e.rlike("^[0-9A-Fa-f]+$"), e).otherwise(F.lower(e))


def _number(seed: Column) -> Column:
    """52 hash bits as a non-negative long."""
    return F.conv(F.substring(F.sha2(seed, 256), 1, 13), 16, 10).cast("long")


def _seed(key: str, *parts: Column) -> Column:
    return F.concat_ws("\x1f", F.lit(key), *parts)


def _power(n: Column) -> Column:
    """10**n as a long, n from 0 to 10."""
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(11)]), n + 1)


def _like(e: Column, stream: Column, hexadecimal: Column) -> Column:
    """e with each letter and digit replaced by one of its kind; two stream characters decide one."""

    def one(c: Column, i: Column) -> Column:
        v = F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), v % 26 + 1, F.lit(1))
        hexed = F.when(hexadecimal & c.rlike("^[0-9a-f]$"), F.substring(F.lit("0123456789abcdef"), v % 16 + 1, F.lit(1)))
        return F.coalesce(hexed, F.when(c.rlike("^[0-9]$"), (v % 10).cast("string")).when(c.rlike(r"^\p{Lu}$"), F.upper(letter)).when(c.rlike(r"^\p{L}$"), letter).otherwise(c))

    return F.array_join(F.transform(F.split(e, ""), one), "")


def _name_word(seed: Column, form: Column, gender: Column, attempt: Column, script: str) -> Column:
    """A capitalised word for each part of form between hyphens, of four syllables drawn by hash and one more every fourth attempt; the last ends as the gender asks."""
    syllables = F.array(*[F.lit(s) for s in SYLLABLES[script]])
    end = F.when(gender == "f", ENDINGS[script]["f"]).when(gender == "m", ENDINGS[script]["m"]).when(gender == "n", ENDINGS[script][""]).otherwise("")
    parts = F.split(form, "-")

    def word(_: Column, i: Column) -> Column:
        drawn = F.transform(F.sequence(F.lit(0), F.lit(3) + (attempt / 4).cast("int")), lambda k: F.element_at(syllables, (_number(F.concat_ws("\x1f", seed, i.cast("string"), k.cast("string"))) % len(SYLLABLES[script])).cast("int") + 1))
        return F.initcap(F.concat(F.array_join(drawn, ""), F.when(i == F.size(parts) - 1, end).otherwise("")))

    return F.array_join(F.transform(parts, word), "-")


def draw(df: DataFrame, key: str) -> DataFrame:
    """df (kind, form, attempt, ...) with new: the surrogate, itself in canonical form. Names come by word: kind 'given f', 'given m', 'given n' or 'surname'.

    Every step is a column of its own, so that no expression holds another twice.
    """
    long = lambda c: F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))
    ip, phone, kept = F.col("kind") == "ip", F.col("kind") == "phone", df.columns
    cut = F.greatest(F.length("form") - 10, F.lit(0))
    card = F.col("kind") == "card"
    df = df.withColumns({"_d": F.when(phone, F.substring(F.col("form"), cut + 1, F.lit(10))).when(card, F.expr("substring(form, 1, length(form) - 1)")).when(F.col("kind") == "ssn", F.col("form")).otherwise(""), "_o": F.split("form", r"\."), "_prefix": F.when(phone, F.substring(F.col("form"), F.lit(1), cut)).otherwise("")})
    df = df.withColumns({"_n": F.length("_d"), "_h": (F.length("_d") / 2).cast("int")})
    df = df.withColumns({
        "_l": F.when(ip, long(F.get("_o", 0)) * 256 + long(F.get("_o", 1))).otherwise(long(F.substring(F.col("_d"), F.lit(1), F.col("_h")))),
        "_r": F.when(ip, long(F.get("_o", 2)) * 256 + long(F.get("_o", 3))).otherwise(long(F.substring(F.col("_d"), F.col("_h") + 1, F.col("_n")))),
        "_ml": F.when(ip, F.lit(65536).cast("long")).otherwise(_power(F.col("_h"))),
        "_mr": F.when(ip, F.lit(65536).cast("long")).otherwise(_power(F.col("_n") - F.col("_h"))),
        "_tag": F.concat_ws(":", "kind", F.col("_n").cast("string"), F.col("attempt").cast("string")),
    })
    for i in range(ROUNDS):  # a keyed bijection on pairs (l < ml, r < mr)
        a, b, m = ("_r", "_l", "_mr") if i % 2 else ("_l", "_r", "_ml")
        df = df.withColumn(a, F.pmod(F.col(a) + _number(_seed(key, F.col("_tag"), F.lit(str(i)), F.col(b).cast("string"))), F.col(m)))
    df = df.withColumn("_digits", F.concat("_prefix", F.lpad(F.col("_l").cast("string"), F.col("_h"), "0"), F.lpad(F.col("_r").cast("string"), F.col("_n") - F.col("_h"), "0")))
    df = df.withColumn("_digits", F.when(card, F.concat("_digits", ((10 - luhn_sum(F.col("_digits"), 0) % 10) % 10).cast("string"))).otherwise(F.col("_digits")))
    octets = [F.shiftright("_l", 8), F.col("_l") % 256, F.shiftright("_r", 8), F.col("_r") % 256]
    df = df.withColumn("_ip", F.concat_ws(".", *[o.cast("string") for o in octets]))
    blocks = F.sequence(F.lit(0), ((F.length("form") * 2 + 64) / 64).cast("int"))
    df = df.withColumn("_stream", F.array_join(F.transform(blocks, lambda b: F.sha2(_seed(key, F.col("kind"), F.col("form"), F.col("attempt").cast("string"), b.cast("string")), 256)), ""))
    email, secret, iban = (F.col("kind") == k for k in ("email", "secret", "iban"))
    df = df.withColumns({
        "_head": F.when(secret, F.regexp_extract("form", SECRET_PREFIX, 0)).when(iban, F.substring("form", 1, 2)).otherwise(""),
        "_end": F.when(email, F.regexp_extract("form", r"\.[a-z]+$", 0)).otherwise(""),
    })
    # short emails may leave no room: after every eighth attempt they grow by a letter
    more = F.when(email, F.repeat(F.lit("x"), (F.col("attempt") / 8).cast("int"))).otherwise("")
    skip = F.when(iban, F.lit(4)).otherwise(F.length("_head"))
    body = F.concat(more, F.substring(F.col("form"), skip + 1, F.length("form") - F.length("_end") - skip))
    df = df.withColumn("_body", _like(body, F.col("_stream"), (F.col("kind") == "ipv6") | (secret & (F.col("_head") == ""))))
    check = F.lpad((98 - mod_97(F.concat("_body", "_head", F.lit("00")))).cast("string"), 2, "0")
    df = df.withColumn("_text", F.concat("_head", F.when(iban, check).otherwise(""), "_body", "_end"))
    df = df.withColumns({"_gender": F.regexp_extract("kind", r"^given (.)$", 1), "_seed": _seed(key, F.col("kind"), F.col("form"), F.col("attempt").cast("string"))})
    name = lambda script: _name_word(F.col("_seed"), F.col("form"), F.col("_gender"), F.col("attempt"), script)
    df = df.withColumn("_name", F.when(F.col("form").rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(F.col("form").rlike(r"\p{IsGreek}"), name("greek")).otherwise(name("latin")))
    new = F.when(F.col("kind").isin("phone", "ssn", "card"), F.col("_digits")).when(ip, F.col("_ip")).when(is_name_word(F.col("kind")), F.col("_name")).otherwise(F.col("_text"))
    return df.select(*kept, new.alias("new"))


def is_name_word(kind: Column) -> Column:
    return kind.startswith("given") | (kind == "surname")


def name_words(form: Column) -> Column:
    """[(kind, form)] of the words of a name in canonical form: the first of several is given, with the gender of the title."""
    words = F.split(form, " ")
    title, n = F.get(words, 0), F.size(words)
    gender = F.when(title.rlike(f"^(?:{_TITLE_F})$"), "f").when(title.rlike(f"^(?:{_TITLE_M})$"), "m").otherwise("n")
    return F.transform(F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda w, i: F.struct(F.when((i == 0) & (n > 2), F.concat(F.lit("given "), gender)).otherwise("surname").alias("kind"), w.alias("form")))


def _fit(e: Column, kind: Column, new: Column) -> Column:
    """The surrogate form written as e is: digits at e's digits, case as e's case."""
    count = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), r"[^0-9]", ""))
    spread = F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(new, count(i), F.lit(1))).otherwise(c)), "")
    cased = F.when((F.upper(e) == e) & (F.lower(e) != e), F.upper(new)).otherwise(new)
    mixed = F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.substring(e, i + 1, F.lit(1)).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)), "")
    spaced = F.when(e.contains(" "), F.trim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)
    return F.when(kind.isin("phone", "ssn", "card"), spread).when(kind == "email", mixed).when(kind == "iban", spaced).when((kind == "secret") & ~e.rlike("^[0-9A-Fa-f]+$"), new).otherwise(cased)


def searched_lines(text: Column) -> Column:
    """The lines of a text that may hold an entity."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(GATE))


def _found(line: Column) -> Column:
    """All entities of a line in order, as written."""
    return F.regexp_extract_all(line, F.lit(f"({ENTITY})"), F.lit(1))


def entity_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """_key (of the text) and e: the entities of each document, as often as they stand there."""
    lines = docs.where(F.col(text).rlike(GATE)).select(F.sha2(text, 256).alias("_key"), F.explode(searched_lines(F.col(text))).alias("_line"))
    return lines.select("_key", F.explode(_found(F.col("_line"))).alias("e"))


def with_kinds(entities: DataFrame) -> DataFrame:
    """e, kind, form of distinct entities as written; those with wrong check digits are none."""
    named = entities.select("e").distinct().withColumn("kind", entity_type(F.col("e"))).where("kind is not null")
    return named.withColumn("form", canonical(F.col("e"), F.col("kind")))


def surrogates(found: DataFrame, config: Surrogates) -> DataFrame:
    """(kind, form, attempt, new) of distinct entities, redrawn until no two of a kind and no real entity are hit. All words of names are one kind here."""
    group = F.when(is_name_word(F.col("kind")), "name").otherwise(F.col("kind")).alias("kind_")
    now = stage(draw(found.select("kind", "form").withColumn("attempt", F.lit(0)), config.key), "surrogates")
    least, waited = None, 0
    while True:
        all_ = now.select(group, "kind", "form", "new")
        first = all_.groupBy("kind_", "new").agg(F.min(F.struct("kind", "form")).alias("_first"), F.count(F.lit(1)).alias("_n"))
        shared = all_.join(first.where("_n > 1"), ["kind_", "new"]).where(F.struct("kind", "form") != F.col("_first")).select("kind", "form")
        real = all_.join(all_.select("kind_", F.col("form").alias("new")).distinct(), ["kind_", "new"], "left_semi").select("kind", "form")
        bad = stage(shared.union(real).distinct(), "collided")
        n = bad.count()
        if not n:
            return now
        least, waited = (n, 0) if least is None or n < least else (least, waited + 1)
        if waited > PATIENCE:
            kinds = ", ".join(sorted(r["kind"] for r in bad.select("kind").distinct().collect()))
            raise RuntimeError(f"the corpus uses up the formats of {n} entities ({kinds})")
        again = now.join(bad, ["kind", "form"], "left_semi").select("kind", "form", (F.col("attempt") + 1).alias("attempt"))
        now = stage(now.join(bad, ["kind", "form"], "left_anti").unionByName(draw(again, config.key)), "surrogates")


def replacements(written: DataFrame, config: Surrogates) -> DataFrame:
    """e, entries: [(text, new text, whether it is a word of a name)] for each entity as written."""
    plain, names = written.where("kind <> 'name'"), written.where("kind = 'name'")
    words = names.select("e", "form", F.posexplode(name_words(F.col("form"))).alias("i", "word")).select("e", F.split("form", " ")[0].alias("title"), "i", F.col("word.kind").alias("kind"), F.col("word.form").alias("form"))
    words = stage(words, "names")
    drawn = surrogates(plain.select("kind", "form").union(words.select("kind", "form")).distinct(), config).select("kind", "form", "new")
    single = plain.join(drawn, ["kind", "form"]).select("e", F.array(F.struct(F.col("e").alias("old"), _fit(F.col("e"), F.col("kind"), F.col("new")).alias("new"), F.lit(False).alias("word"))).alias("entries"))
    persons = words.join(drawn, ["kind", "form"]).groupBy("e", "title").agg(F.array_sort(F.collect_list(F.struct("i", "form", "new"))).alias("parts"))  # a few words a name
    whole = F.concat(F.col("title"), F.when(F.col("e").rlike(r"^\S+\. "), ". ").otherwise(" "), F.array_join(F.transform("parts", lambda x: x["new"]), " "))
    entry = lambda old, new, word: F.struct(old.alias("old"), new.alias("new"), F.lit(word).alias("word"))
    named = persons.select("e", F.concat(F.array(entry(F.col("e"), whole, False)), F.transform("parts", lambda x: entry(x["form"], x["new"], True))).alias("entries"))
    return single.unionByName(named)


def text_maps(rows: DataFrame, new: DataFrame) -> DataFrame:
    """_key, _map (text -> new text) and _names (pattern of the words of names, or null) of each text with entities.

    An entity in very many texts is sent once for each of many salts, so it is no hot key.
    """
    salts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int"))
    sent = rows.select("e", "_salt").distinct().join(new, "e")
    entries = rows.join(sent, ["e", "_salt"]).select("_key", F.inline("entries"))
    entries = entries.groupBy("_key", "old").agg(F.min("new").alias("new"), F.max("word").alias("word"))
    word = F.when(F.col("word"), F.col("old"))
    maps = entries.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_map"), F.sort_array(F.collect_list(F.struct(F.length(word).alias("n"), word.alias("w"))), asc=False).alias("_words"))
    words = F.filter("_words", lambda x: x["w"].isNotNull())
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.transform(words, lambda x: x["w"]), "|"), F.lit(r")(?!\p{L})"))
    return maps.select("_key", "_map", F.when(F.size(words) > 0, pattern).alias("_names"))


def replace_pii(docs: DataFrame, config: Surrogates, text: str = "text", found: str | None = None) -> DataFrame:
    """docs with the entities of text replaced; found: also add their number under this name (a column of that name is replaced)."""
    distinct = docs.select(text).where(F.col(text).rlike(GATE))
    rows = stage(entity_rows(distinct, text).groupBy("_key", "e").count(), "entity_rows")
    written = stage(with_kinds(rows), "entities")
    new = stage(replacements(written, config), "replacements")
    key, of_text, names = fresh(docs, "key"), fresh(docs, "map"), fresh(docs, "names")
    maps = stage(text_maps(rows, new), "maps").toDF(key, of_text, names)  # for each text with entities, at most as many as it has

    known = lambda es: F.transform(es, lambda e: F.coalesce(F.element_at(F.col(of_text), e), e))
    weave = lambda pieces, es: F.array_join(F.zip_with(pieces, es, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    line = lambda x: F.when(x.rlike(GATE), weave(F.split(x, ENTITY, -1), known(_found(x)))).otherwise(x)
    # a text that names persons is searched as a whole, also for the words of their names
    both = F.concat(F.lit(f"{ENTITY}|"), F.col(names))
    everywhere = F.regexp_extract_all(F.col(text), F.concat(F.lit("("), both, F.lit(")")), F.lit(1))
    may = F.coalesce(F.col(text).rlike(GATE), F.lit(False))
    order = [c for c in docs.columns if c != found] + ([found] if found else [])
    hit = docs.where(may).withColumn(key, F.sha2(text, 256)).join(maps, key, "left")
    real = lambda es: F.size(F.filter(es, lambda e: F.map_contains_key(F.col(of_text), e)))
    count = F.when(F.col(names).isNotNull(), real(everywhere)).when(F.col(of_text).isNotNull(), real(F.flatten(F.transform(searched_lines(F.col(text)), _found)))).otherwise(0)
    changed = F.when(F.col(names).isNotNull(), weave(F.split(F.col(text), both, -1), known(everywhere))).when(F.col(of_text).isNotNull(), F.array_join(F.transform(F.split(text, "\n"), line), "\n")).otherwise(F.col(text))
    hit = hit.withColumns({text: changed, **({found: count} if found else {})}).select(*order)
    rest = docs.where(~may)
    return hit.unionByName((rest.withColumn(found, F.lit(0)) if found else rest).select(*order))
