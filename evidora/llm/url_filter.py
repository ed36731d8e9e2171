"""URL filter: path rules first, then a blocked Bloom filter before an exact hash join with listed canonical URLs.

Native: DataFrame functions only. The Bloom filter is split into blocks of eight 32-bit words; a key sets one bit in
each word of one block, so a probe is one equi-join on the block number and eight bit tests. Only rows that pass the
filter reach the exact join, which removes its false positives.

Defined results: a null url, or one without "://", has empty host and path and canonical form null, fits no rule and is
allowed. Repeated pages are judged alike and each kept; of fitting rules the longest wins, of those the smaller text. A url of any
length is judged whole. Extra columns, whatever their names, are kept. An empty list or an empty table works.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
#: Odd multipliers, one for each word of a block: the fixed values of the public Parquet split-block filter.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
BITS_PER_KEY = 16
#: A side is broadcast only if its counted rows times this many bytes fit below the bound.
BROADCAST_BYTES, BLOCK_BYTES, KEY_BYTES = 32 << 20, 160, 400
#: Query parameters that do not identify a page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


@dataclass(frozen=True)
class Rule:
    """verdict for all urls of host and its subdomains whose path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest from the '?' or '#' on); empty strings for null urls and those without '://'."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    raw = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(after, r"^[^?#]*([?#][\s\S]*)?$", 1)
    return F.translate(raw, UPPER, LOWER), path, rest


def canonical_url(host: Column, path: Column, rest: Column) -> Column:
    """host without 'www.' and default port, path without doubled or closing slashes, other query parameters in order."""
    h = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    p = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"/$", "")
    query = F.regexp_extract(rest, r"^\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(host != "", F.concat(h, p, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def match_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, or nulls. rules: a short list given by the caller."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (F.lit(None).cast("string"),) * 2 if text is None else (text, verdict)


def _block(key: Column, blocks: int) -> Column:
    return F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))


def _masks(key: Column) -> list[Column]:
    """The bit of each word, from a hash that is independent of the block's."""
    low = F.xxhash64(key, F.lit(7)).bitwiseAND(F.lit((1 << 31) - 1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(low * F.lit(s), 27).bitwiseAND(F.lit(31)).cast("int")) for s in SALTS]


def build_bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row a block in use: __block and words __w0 to __w7; combined on the map side."""
    masks = listed.select(_block(F.col(key), blocks).alias("__block"), *[m.alias(f"__w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return masks.groupBy("__block").agg(*[F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule] = (), url: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages with host, path, rule, verdict ('allow' or 'block'), possible (passed the Bloom filter) and hit (listed); columns of these names are replaced.

    listed: any columns, of which url is judged by its canonical form. Its distinct keys are counted once to size the
    filter; the filter and the list are broadcast only if they fit broadcast_bytes. Beyond it the distinct keys of the pages, not the
    pages, are shuffled to the filter's blocks and, where they may be listed, to the list. The verdicts of keys come back to the pages
    by key with a salt from the whole row, so a hot url of different pages is no hot key; urls without a key take no part in any join.
    """
    keys = listed.select(canonical_url(*url_parts(F.col(url))).alias("__listed")).where("__listed is not null").distinct()
    n = keys.count()
    blocks = max(1, -(-n * BITS_PER_KEY // (32 * WORDS)))
    bloom = build_bloom(keys, "__listed", blocks)
    small = blocks * BLOCK_BYTES <= broadcast_bytes and n * KEY_BYTES <= broadcast_bytes
    host, path, rest = url_parts(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "possible", "hit")]
    key = fresh(pages, "key")
    base = pages.withColumns({"host": host, "path": path}).withColumn(key, canonical_url(F.col("host"), F.col("path"), rest)).select(*kept, "host", "path", key)
    if small:
        probe = _probe(base, key, F.broadcast(bloom), blocks)
        flag = fresh(probe, "listed")
        out = probe.join(F.broadcast(keys.withColumnRenamed("__listed", flag)), F.when(F.col("possible"), F.col(key)) == F.col(flag), "left").withColumn("hit", F.col(flag).isNotNull())
    else:
        salts = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        salt = fresh(base, "salt")
        by = [c for c, t in pages.select(*kept).dtypes if "map<" not in t and "variant" not in t]  # what can be hashed
        base = base.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)))
        sent = base.where(F.col(key).isNotNull()).select(key, salt).distinct()
        judged = _probe(sent.select(F.col(key).alias("__k")).distinct(), "__k", bloom, blocks).where("possible")
        judged = judged.join(keys, F.col("__k") == F.col("__listed"), "left").select("__k", F.lit(True).alias("possible"), F.col("__listed").isNotNull().alias("hit"))
        back = sent.join(judged, F.col(key) == F.col("__k")).select(F.col(key).alias("__k"), F.col(salt).alias("__s"), "possible", "hit")
        with_key = base.where(F.col(key).isNotNull()).join(back, (F.col(key) == F.col("__k")) & (F.col(salt) == F.col("__s")), "left")
        no = F.lit(False)
        with_key = with_key.withColumns({"possible": F.coalesce("possible", no), "hit": F.coalesce("hit", no)}).select(*kept, "host", "path", "possible", "hit")
        out = with_key.unionByName(base.where(F.col(key).isNull()).select(*kept, "host", "path", no.alias("possible"), no.alias("hit")))
    rule, verdict = match_rule(F.col("host"), F.col("path"), list(rules))
    out = out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("hit"), "block").otherwise("allow"))})
    return out.select(*kept, "host", "path", "rule", "verdict", "possible", "hit")


def _probe(df: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """df with possible: whether all eight bits of its key are set; rows without a key meet no block."""
    block, names = fresh(df, "block"), [fresh(df, f"w{i}") for i in range(WORDS)]
    own = bloom.toDF(block, *names)
    out = df.join(own, _block(F.col(key), blocks) == F.col(block), "left")
    passed = F.lit(True)
    for w, m in zip(names, _masks(F.col(key))):
        passed = passed & (F.col(w).bitwiseAND(m) != 0)
    return out.withColumn("possible", F.coalesce(passed & F.col(key).isNotNull(), F.lit(False))).drop(block, *names)
