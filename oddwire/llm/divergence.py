"""How far the sources of a language differ from each other and from the language, term by term.

Tasks count terms in their documents; counts are summed by (lang, source, term). Terms kept by a
language get ids by their place in a written table; a block of ids holds at most ``BLOCK_TERMS``
terms, so no task ever holds a vocabulary. Each group has, in each block of its language, one row
with its sorted term ids and their counts.

Each unordered pair of groups meets once a block. Its sorted ids are intersected by galloping:
the longer list is searched from the last place found, in doubling steps. Terms of both, of either
alone, and of neither are priced apart; the last with one multiplication, as all have one price.
Prices are symmetric, so a pair's sum serves both ways.

All numbers are integers: ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))`` with N occurrences of V
kept terms in the group, and ``f = floor((p - q)^2 / (p + q))``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddwire.llm import words
from oddwire.llm.shared import written

#: Documents of a language a kept term occurs in at least.
MIN_DOCUMENTS = 10
#: Terms reported for each group.
TOP_TERMS = 10
#: Term ids of a block, a power of two.
BLOCK_TERMS = 1 << 14
#: Sources on the left of the pairs of one task, about.
PAIR_SOURCES = 16
#: Distinct (group, term) entries a task gathers before it sends them.
FLUSH = 1_000_000

_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> list[bytes]:
    """Longest runs of letters and non-ASCII bytes, A-Z in lower case."""
    return text.translate(_TERMS).split(b" ")


def _counts(flush: int):
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in COUNTS.split(", ")]

    def send(groups: dict) -> pa.RecordBatch:
        terms: list = []
        for totals, documents in groups.values():
            # A row without a term says that the group occurs.
            totals[b""] = documents[b""] = 0
            terms += totals
        sizes = [len(totals) for totals, _ in groups.values()]
        of = words.arrow(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))
        # Both counters met their terms in the same order.
        numbers = [
            np.fromiter(chain.from_iterable(pair[k].values() for pair in groups.values()), np.int64)
            for k in (0, 1)
        ]
        ends = np.zeros(len(terms) + 1, dtype=np.int32)
        np.cumsum(np.fromiter(map(len, terms), np.int32), out=ends[1:])
        known = pa.py_buffer(np.packbits(ends[1:] > ends[:-1], bitorder="little"))
        buffers = [known, pa.py_buffer(ends), pa.py_buffer(b"".join(terms))]
        groups_of = [words.arrow([group[k] for group in groups], kinds[k]).take(of) for k in (0, 1)]
        found = pa.Array.from_buffers(kinds[2], len(terms), buffers)
        return pa.RecordBatch.from_arrays([*groups_of, found, *map(words.arrow, numbers)], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = defaultdict(lambda: (Counter(), Counter()))
        for batch in words.slices(batches):
            pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for group, text in zip(pairs, words.raw_texts(batch.column("text"))):
                own = terms_of(text.tobytes())
                totals, documents = groups[group]
                # Iterators and lists are counted in C, mappings are not.
                totals.update(own)
                documents.update(iter(dict.fromkeys(own)))
            if sum(len(totals) for totals, _ in groups.values()) > flush:
                yield send(groups)
                groups.clear()
        if groups:
            yield send(groups)

    return task


def term_counts(docs: DataFrame, flush: int = FLUSH) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group, and
    a row without a term for each group."""
    texts = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
        "text",
    )
    return (
        texts.mapInArrow(_counts(flush), COUNTS)
        # Tasks have added up what they can, a second time before the exchange would be in vain.
        .repartition("lang", "source", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def price(count, total, kept):
    """p of a term: on numbers and numpy arrays. Two steps keep the products in 64 bits."""
    below = total + 2 * kept
    first = (count + 2) * 100_000
    return 1 + first // below * 10_000 + first % below * 10_000 // below


def _price(count: Column, total: Column, kept: Column) -> Column:
    """The same on columns of longs."""
    below = total + 2 * kept
    first = (count + 2) * F.lit(100_000).cast("long")
    whole = (first - first % below) / below  # exact: a multiple, below 10^14
    rest = (first % below) * 10_000
    part = (rest - rest % below) / below
    return F.lit(1).cast("long") + whole.cast("long") * 10_000 + part.cast("long")


def difference(p, q):
    """f of two terms, on numbers and numpy arrays."""
    return (p - q) * (p - q) // (p + q)


def gallop(small: np.ndarray, large: np.ndarray, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places in both sorted arrays of what they share.

    A stretch of the smaller one is looked up in a window of the larger that begins where the
    stretch before it ended and doubles until it reaches the stretch's last number.
    """
    left, right, low = [], [], 0
    for begin in range(0, len(small), step):
        part = small[begin : begin + step]
        width = step
        while low + width < len(large) and large[low + width] < part[-1]:
            width *= 2
        window = large[low : low + width + 1]
        at = np.searchsorted(window, part)
        hit = np.flatnonzero(at < len(window))
        hit = hit[window[at[hit]] == part[hit]]
        left.append(begin + hit)
        right.append(low + at[hit])
        low += int(at[-1])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def pair_sum(ids1, counts1, total1, ids2, counts2, total2, terms: int, kept: int) -> int:
    """Sum of f over the ``terms`` of a block, for two groups with (id, count) sorted by id."""
    if len(ids1) > len(ids2):
        ids1, counts1, total1, ids2, counts2, total2 = ids2, counts2, total2, ids1, counts1, total1
    left, right = gallop(ids1, ids2)
    p, q = price(counts1, total1, kept), price(counts2, total2, kept)
    p0, q0 = price(0, total1, kept), price(0, total2, kept)
    only1, only2 = np.ones(len(p), bool), np.ones(len(q), bool)
    only1[left] = only2[right] = False
    found = int(difference(p[left], q[right]).sum())
    found += int(difference(p[only1], q0).sum()) + int(difference(p0, q[only2]).sum())
    absent = terms - len(ids1) - len(ids2) + len(left)
    return found + absent * difference(p0, q0)


PAIR = "lang string, source string, item string, value long"


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sides = [["ids1", "counts1"], ["ids2", "counts2"]]
    for batch in batches:
        values = []
        lists = [[batch.column(k) for k in side] for side in sides]
        whole = {k: batch.column(k).to_pylist() for k in ("total1", "total2", "terms", "kept")}
        for row in range(len(batch)):
            one, two = ([c[row].values.to_numpy() for c in side] for side in lists)
            values.append(
                pair_sum(
                    *one,
                    whole["total1"][row],
                    *two,
                    whole["total2"][row],
                    whole["terms"][row],
                    whole["kept"][row],
                )
            )
        yield pa.RecordBatch.from_arrays(
            [batch.column(k) for k in ("lang", "source", "item")] + [words.arrow(values, pa.int64())],
            ["lang", "source", "item", "value"],
        )


def audit(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """lang, source, part, item, value, rank: see the module.

    Part ``pair`` has for each group every other source of its language, with f summed over all
    kept terms of the language (0 without any). Part ``term`` has the group's kept terms that occur
    in it and are likelier there than in the language, with f, to the rank ``top_terms``. Ranks
    run from 1 by falling value, then rising item.

    Null, lang and source count as '', so a table without either still gives groups; empty texts
    have no terms; repeated rows are documents like any other; an empty table gives no rows. Other
    columns are not looked at. Counts up to 9 * 10^13 are exact.
    """
    counts = written(term_counts(docs), "term-counts")
    found = counts.where("term IS NOT NULL")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = kept.where(F.col("docs") >= min_documents).drop("docs")
    # Written once, so an id is the row's place for good: partition and place in it.
    kept = written(kept.withColumn("id", F.monotonically_increasing_id()), "kept-terms")
    langs = written(
        kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")),
        "languages",
    )
    block = F.shiftright("id", BLOCK_TERMS.bit_length() - 1)
    own = written(
        found.join(kept, ["lang", "term"]).select(
            "lang", "source", "term", "n", "lang_n", "id", block.alias("block")
        ),
        "group-terms",
    )
    groups = counts.where("term IS NULL").select("lang", "source")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written(
        groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang",
            "source",
            F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("kept", F.lit(0)).alias("kept"),
            F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        ),
        "groups",
    )
    return _pairs(own, kept.select("lang", block.alias("block")), groups).unionByName(
        _terms(own, groups, top_terms)
    )


def _terms(own: DataFrame, groups: DataFrame, top_terms: int) -> DataFrame:
    p = _price(F.col("n"), F.col("total"), F.col("kept"))
    q = _price(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    priced = own.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")
    )
    value = F.expr("(p - q) * (p - q) div (p + q)").alias("value")
    likelier = priced.where("p > q").select("lang", "source", "item", value)
    return _ranked(likelier, "term").where(F.col("rank") <= top_terms)


def _pairs(own: DataFrame, blocks: DataFrame, groups: DataFrame) -> DataFrame:
    entry = F.sort_array(F.collect_list(F.struct("id", "n")))
    lists = own.groupBy("lang", "block", "source").agg(entry.alias("entries"))
    blocks = blocks.groupBy("lang", "block").agg(F.count("*").alias("terms"))
    shares = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / F.lit(PAIR_SOURCES)).cast("int").alias("shares")
    )
    # Every group has a row in every block of its language, if only an empty one.
    rows = (
        groups.join(blocks, "lang")
        .join(lists, ["lang", "block", "source"], "left")
        .join(shares, "lang")
    )
    none = F.array().cast("array<struct<id:long,n:long>>")
    rows = written(
        rows.withColumn("entries", F.coalesce("entries", none)).select(
            "lang",
            "block",
            "source",
            "terms",
            "kept",
            "total",
            F.col("entries.id").alias("ids"),
            F.col("entries.n").alias("counts"),
            "shares",
        ),
        "block-lists",
    )
    left = rows.select(
        "lang",
        "block",
        F.pmod(F.xxhash64("source"), F.col("shares")).cast("int").alias("share"),
        "source",
        "terms",
        "kept",
        F.col("total").alias("total1"),
        F.col("ids").alias("ids1"),
        F.col("counts").alias("counts1"),
    )
    right = rows.select(
        "lang",
        "block",
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        F.col("source").alias("item"),
        F.col("total").alias("total2"),
        F.col("ids").alias("ids2"),
        F.col("counts").alias("counts2"),
    )
    sums = (
        left.join(right, ["lang", "block", "share"])
        .where("source < item")
        .mapInArrow(_pair_sums, PAIR)
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    # Pairs of a language without kept terms have no block.
    bare = groups.where("kept = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source < item")
    sums = written(
        sums.unionByName(bare.withColumn("value", F.lit(0).cast("long"))), "pair-sums"
    )
    both = sums.unionByName(
        sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    )
    return _ranked(both, "pair")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value",
        F.row_number().over(order).alias("rank"),
    )
