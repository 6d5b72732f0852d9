"""URL rules looked up through a blocked Bloom filter and confirmed by an exact hash join.

A rule lists a canonical URL, that is a host and the beginning of a path. It fits
its host and all subdomains if the path of a URL starts with the rule's; the
longest rule wins (among equally long ones that with the longer host, and of two
verdicts on one rule ``block``). A URL that no rule fits is not listed and gets
``otherwise``.

For every shape of the rules (labels of the host, code points of the path) a URL
has one canonical URL that a rule of this shape would list. Each is looked up in
the filter: its hash names a block of four words and one bit in each. The blocks
are a table that is broadcast; their number grows with the rules up to
``MAX_BLOCKS`` (8,192 kB of bits in all), beyond which more URLs pass for nothing
but none is lost: what passes is joined with the rules by the canonical URL
itself. A listed URL that very many pages share is dealt out over ``SALTS`` keys.

Everything is DataFrame functions; only the number of rules and their distinct
shapes come to the driver.

Cases: a null URL and one without ``://`` have an empty host and path, which no
rule fits; very long URLs are cut nowhere; repeated rows are judged one by one,
also with a null id; no rules, or rules without a host, fit nothing; further
columns of the pages are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelab.llm.text import positional
from gaugelab.storage import written

#: (host, path, verdict) of the rules that the query applies.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

BLOCK_BITS = 256
BITS_PER_RULE = 16
MAX_BLOCKS = 1 << 18
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_WORDS = range(BLOCK_BITS // 64)


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty where there is none."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _URL, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def _labels(host: str) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _listed(rules: DataFrame) -> DataFrame:
    """One row per canonical URL: key, its shape and its verdict."""
    plain = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    merged = plain.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block comes after allow
    return merged.select(F.concat("host", "path").alias("key"), _labels("host").alias("labels"), F.length("path").alias("path_length"), F.length("host").alias("host_length"), "verdict")


def _mask(hash_column: str, word: int) -> Column:
    """The bit that a hash sets in one word of its block."""
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hash_column}, {40 + 6 * word}) & 63 as int))")


def block_count(rules: int) -> int:
    """A power of two that leaves a rule ``BITS_PER_RULE`` bits at least, up to the bound."""
    blocks = 1
    while blocks * BLOCK_BITS < rules * BITS_PER_RULE and blocks < MAX_BLOCKS:
        blocks *= 2
    return blocks


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of a column ``key``: block and its words; blocks without a bit are left out."""
    hashed = keys.select(F.xxhash64("key").alias("h"))
    return hashed.groupBy(F.col("h").bitwiseAND(F.lit(blocks - 1).cast("long")).alias("block")).agg(*[F.bit_or(_mask("h", w)).alias(f"w{w}") for w in _WORDS])


def _with_block(keys: DataFrame, blocks: int) -> DataFrame:
    return keys.withColumn("h", F.xxhash64("key")).withColumn("block", F.col("h").bitwiseAND(F.lit(blocks - 1).cast("long")))


def possible(keys: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """The rows whose ``key`` the filter lets through; the filter holds at most ``MAX_BLOCKS`` rows."""
    found = _with_block(keys, blocks).join(F.broadcast(filter_blocks), "block")
    for w in _WORDS:
        found = found.where(F.col(f"w{w}").bitwiseAND(_mask("h", w)) != 0)
    return found.select(*keys.columns)


def impossible(keys: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """The other rows: those whose ``key`` was surely not entered."""
    found = _with_block(keys, blocks).join(F.broadcast(filter_blocks), "block", "left")
    misses = [F.coalesce(F.col(f"w{w}"), F.lit(0)).bitwiseAND(_mask("h", w)) == 0 for w in _WORDS]
    return found.where(reduce(or_, misses)).select(*keys.columns)


def candidates(urls: DataFrame, shapes: Sequence[tuple[int, int]]) -> DataFrame:
    """row and key: the canonical URL that a rule of each shape would have to list to fit the URL."""
    dots, length = _labels("host"), F.length("path")
    keys = [F.when((dots >= labels) & (length >= n), F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, n))) for labels, n in shapes]
    return urls.where("host <> ''").select("row", F.explode(F.array(*keys)).alias("key")).where("key is not null")


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule (the longest that fits, or null) and verdict of every row."""
    named, (page, url) = positional(pages, id_column, url_column)
    host, path = host_and_path(url)
    # Written, so that row numbers stay what they are when a task runs again.
    urls = written(named.select(F.monotonically_increasing_id().alias("row"), F.col(page).alias("page_id"), host.alias("host"), path.alias("path")), "urls")

    listed = written(_listed(rules), "rules")
    known = listed.agg(F.count("*").alias("n"), F.collect_set(F.struct("labels", "path_length")).alias("shapes")).first()
    shapes = sorted((s["labels"], s["path_length"]) for s in known["shapes"]) or [(1, 0)]
    blocks = block_count(known["n"])

    passed = written(possible(candidates(urls, shapes), written(bloom_blocks(listed, blocks), "bloom"), blocks), "passed")
    # The rules that pages really hit, once per salt.
    hit = listed.join(passed.select("key").distinct(), "key", "left_semi")
    dealt = hit.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fitting = passed.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(dealt, ["key", "salt"])
    longest = fitting.groupBy("row").agg(F.max(F.struct(F.length("key").alias("n"), "host_length", "key", "verdict")).alias("best"))
    return urls.join(longest, "row", "left").select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )
