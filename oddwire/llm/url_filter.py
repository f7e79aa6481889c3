"""Verdicts on URLs by a list of (host, path, verdict) entries, in DataFrame functions alone.

A URL is cut into host and path. An entry fits its host and all subdomains, if the URL's path
starts with its path; of those that fit, the longest wins. The canonical forms a URL may be listed
under are the ends of its host at dots with the beginnings of its path, as far as entries of so
many labels and of such a path length exist.

A blocked Bloom filter holds the entries: one 64-bit word a block, several bits of it an entry. A
form whose bits are not all set is not listed. What passes is joined with the list by host and
path, which removes false positives. The filter is bounded by ``MOST_BLOCKS`` and broadcast, the
list itself only while it is at most ``BROADCAST_ENTRIES`` long.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddwire.llm.shared import stored, with_row_key, written

#: Entries a block of the filter is to hold; blocks the filter may have.
BLOCK_ENTRIES = 4
MOST_BLOCKS = 1 << 20
#: Bits of an entry in its block.
BITS = 6
#: Entries up to which the list is broadcast; longer ones are joined by a shuffle.
BROADCAST_ENTRIES = 50_000
#: Place of the rule's length in the number that orders the rules of a URL.
_STEP = 1 << 31


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for a null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return _lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.split(host, r"\.")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("rule_host", "rule_path"), F.lit(blocks))


def _mask() -> Column:
    """The bits of an entry in its block, from a hash of its own."""
    hash_ = F.xxhash64("rule_path", "rule_host", F.lit("bits"))
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        place = F.shiftrightunsigned(hash_, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def bloom_filter(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of the blocks with entries."""
    return rules.groupBy(_block(blocks).alias("block")).agg(F.bit_or(_mask()).alias("bits"))


def listed(rules: DataFrame) -> DataFrame:
    """(rule_host, rule_path, blocks): every entry once; of contradictory verdicts block counts.

    Entries without host or path are left out; verdicts other than block allow.
    """
    return (
        rules.select(
            _lower(F.col("host")).alias("rule_host"),
            F.col("path").alias("rule_path"),
            F.coalesce(F.col("verdict") == "block", F.lit(False)).alias("blocks"),
        )
        .dropna(subset=["rule_host", "rule_path"])
        .groupBy("rule_host", "rule_path")
        .agg(F.max("blocks").alias("blocks"))
    )


def _forms(most_labels: int, lengths: list[int]) -> Column:
    """All (rule_host, rule_path) under which a URL may be listed."""
    labels = _labels(F.col("host"))
    counts = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels)))
    ends = F.transform(counts, lambda n: F.array_join(F.slice(labels, -n, n), "."))
    known = F.filter(
        F.array(*map(F.lit, lengths)), lambda length: length <= F.char_length("path")
    )

    def with_paths(host: Column) -> Column:
        return F.transform(
            known,
            lambda length: F.struct(
                host.alias("rule_host"),
                F.substring(F.col("path"), F.lit(1), length).alias("rule_path"),
            ),
        )

    return F.flatten(F.transform(ends, with_paths))


def judge(pages: DataFrame, rules: DataFrame, id_column: str, default: str = "allow") -> DataFrame:
    """One row per page: row_key, the id, host, path, rule, verdict.

    ``pages`` has the id and ``url``, ``rules`` has host, path and verdict (allow or block). A URL
    that no rule fits gets the default and a null rule. Null URLs and URLs without ``://`` have an
    empty host and path; repeated rows and ids each give a row; other columns are not looked at.
    ``rule`` is host and path of the rule together. Of two rules of one length the longer host
    wins. Empty tables give no rows, or the default everywhere.
    """
    rules = written(listed(rules), "url-rules")
    count, most_labels = rules.agg(F.count("*"), F.max(F.size(_labels(F.col("rule_host"))))).first()
    # As many as there are lengths of paths: these follow the longest entry, not the list.
    lengths = sorted(
        row[0] for row in rules.select(F.char_length("rule_path")).distinct().collect()
    )
    pages = stored(pages, "pages")
    rows = with_row_key(pages, [F.col(id_column), F.col("url")])
    host, path = host_and_path(F.col("url"))
    rows = rows.select("row_key", id_column, host.alias("host"), path.alias("path"))
    if not count:
        return rows.select(
            "*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * BLOCK_ENTRIES < count:
        blocks *= 2
    own = ["row_key", id_column, "host", "path"]
    forms = rows.select(*own, F.posexplode_outer(_forms(most_labels, lengths)).alias("at", "form"))
    forms = forms.select(*own, F.coalesce("at", F.lit(0)).alias("at"), "form.*")
    bloom = F.broadcast(bloom_filter(rules, blocks))
    probed = forms.withColumn("block", _block(blocks)).join(bloom, "block", "left")
    possible = F.coalesce(F.col("bits").bitwiseAND(_mask()) == _mask(), F.lit(False))
    # The first form of a URL stays, so that every page keeps a row.
    probed = probed.select(*own, "at", "rule_host", "rule_path", possible.alias("possible"))
    probed = probed.where("possible OR at = 0")
    if count <= BROADCAST_ENTRIES:
        rules = F.broadcast(rules)
    found = probed.join(rules, ["rule_host", "rule_path"], "left")
    host_length = F.char_length("rule_host").cast("long")
    length = host_length + F.char_length("rule_path")
    order = F.when(
        F.col("blocks").isNotNull(),
        (length * F.lit(_STEP) + host_length) * 2 + F.col("blocks").cast("int"),
    )
    # The forms of a page are neighbours: one row a page is left before the only exchange.
    best = found.groupBy(*own).agg(F.max(order).alias("best"))
    half = F.shiftright("best", 1)
    host_length = half.bitwiseAND(F.lit(_STEP - 1)).cast("int")
    path_length = F.shiftright(half, 31).cast("int") - host_length
    rule = F.concat(
        F.substring(F.col("host"), F.char_length("host") - host_length + 1, host_length),
        F.substring(F.col("path"), F.lit(1), path_length),
    )
    verdict = (
        F.when(F.col("best").isNull(), default)
        .when(F.col("best").bitwiseAND(F.lit(1)) == 1, "block")
        .otherwise("allow")
    )
    return best.select(*own, rule.alias("rule"), verdict.alias("verdict"))
