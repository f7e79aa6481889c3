"""Exact similarity join of shingle sets: links of Jaccard similarity >= 75 %, and their classes.

Two ways of skipping work by relations between sets make it linear in groups of near copies:

* Answers from a similar set. Equal sets are one class. Classes of about one size that share a min-hash meet the
  most central of them, their leader (the one with the most common shingles), and are compared
  with it alone; a link also records what the set lost and gained against its leader. Linked sets form clusters, whose inner pairs need no
  further look. A pair (x, y) of two clusters starts from the computed intersection of x's leader
  with y: ``|x & y| = |r & y| - |lost & y| + |gained & y|``. The sizes of lost and gained decide
  most pairs without reading x or y.
* Blocks of index lists. The prefix index holds the rarest shingles of every class, one list a
  shingle, cut into blocks by cluster, set size and position. A pair of blocks of one cluster, or
  whose sizes or positions rule out the needed overlap, is skipped as a whole.

The min-hash step is a shortcut only: the prefix index finds every link between clusters.
Shingles are ordered by a counting sketch of all documents; any order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddwire.llm import words
from oddwire.llm.components import components
from oddwire.llm.members import bit_table, maybe_in, without
from oddwire.llm.shared import stored, with_row_key, written

SHINGLE_WORDS = 5
MIN_HASHES = 6
#: Min-hashes a class must share with a leader to be compared with it.
SHARED_HASHES = 3
#: Counters of the sketch that orders the shingles; a task counts to 255 in each.
LOG2_COUNTERS = 22
COUNTER_BLOCK = 1 << 16
#: Entries of a block of an index list, about.
BLOCK_ENTRIES = 256

_HASHES = np.random.default_rng(11).integers(0, 2**63, MIN_HASHES, dtype=np.uint64) * 2 + 1

PROFILE = (
    "row_key long, doc_id long, n long, set1 long, set2 long, keys array<long>, "
    "block int, counts binary"
)


def linked(overlap, n1, n2):
    """100 * overlap >= 75 * union, on numbers or columns."""
    return 7 * overlap >= 3 * (n1 + n2)


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - LOG2_COUNTERS)).astype(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(
        words.arrow(ends.astype(np.int32)), words.arrow(flat.view(np.int64))
    )


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, identity and min-hashes of each set; at the end the task's shingle counts."""
    total = np.zeros(1 << LOG2_COUNTERS, dtype=np.uint8)
    names = [field.split()[0] for field in PROFILE.split(", ")]
    for batch in words.slices(batches):
        sizes, first, second, keys = [], [], [], []
        for text in words.raw_texts(batch.column("text")):
            shingles = words.shingle_set(text, SHINGLE_WORDS)
            sizes.append(len(shingles))
            first.append(int(words.mix(shingles).sum(dtype=np.uint64)))
            second.append(int(words.mix(shingles ^ _HASHES[0]).sum(dtype=np.uint64)))
            if len(shingles):
                keys.append(np.array([words.mix(shingles * h).min() for h in _HASHES]))
            else:
                keys.append(np.zeros(0, np.uint64))
            counters = np.unique(_counters(shingles))
            total[counters] += total[counters] < 255
        rows = len(batch)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row_key"),
                batch.column("doc_id"),
                words.arrow(sizes, pa.int64()),
                words.arrow(np.array(first, np.uint64).view(np.int64)),
                words.arrow(np.array(second, np.uint64).view(np.int64)),
                _lists(keys),
                pa.nulls(rows, pa.int32()),
                pa.nulls(rows, pa.binary()),
            ],
            names,
        )
    parts = total.reshape(-1, COUNTER_BLOCK)
    used = [k for k in range(len(parts)) if parts[k].any()]
    empty = [pa.nulls(len(used), pa.int64())] * 5 + [pa.nulls(len(used), pa.list_(pa.int64()))]
    counts = words.arrow([parts[k].tobytes() for k in used], pa.binary())
    yield pa.RecordBatch.from_arrays([*empty, words.arrow(used, pa.int32()), counts], names)


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank of each counter's count over all tasks, in steps of an eighth, as a byte a counter."""
    current, total = None, np.zeros(COUNTER_BLOCK, dtype=np.uint64)

    def ranked() -> pa.RecordBatch:
        ranks = np.floor(8 * np.log2(1 + total.astype(np.float64))).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [words.arrow([current], pa.int32()), words.arrow([ranks.tobytes()], pa.binary())],
            ["block", "ranks"],
        )

    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts")):
            if block != current:
                if current is not None:
                    yield ranked()
                current, total[:] = block, 0
            total += np.frombuffer(counts.as_py(), np.uint8)
    if current is not None:
        yield ranked()


def _rarity(profiles: DataFrame) -> np.ndarray:
    """Rank of each counter; shingles are ordered by it and hash. Ranks alone reach the driver."""
    rows = (
        profiles.where("block IS NOT NULL")
        .select("block", "counts")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_ranks, "block int, ranks binary")
        .toArrow()
    )
    ranks = np.zeros((max((1 << LOG2_COUNTERS) // COUNTER_BLOCK, 1), COUNTER_BLOCK), np.uint8)
    for block, row in zip(rows.column("block"), rows.column("ranks")):
        ranks[block.as_py()] = np.frombuffer(row.as_py(), np.uint8)
    return ranks.reshape(-1)


def sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the rows named by ids: only their sets leave the tasks."""
    wanted = bit_table(ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            keep = maybe_in(wanted.value, batch.column("row_key").to_numpy())
            chosen = batch.filter(words.arrow(keep))
            texts = words.raw_texts(chosen.column("text"))
            sets = [words.shingle_set(text, SHINGLE_WORDS) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [chosen.column("row_key"), _lists(sets)], ["id", "shingles"]
            )

    found = rows.select("row_key", "text").mapInArrow(task, "id long, shingles array<long>")
    sets = written(found.join(ids, "id", "left_semi"), "sets")
    wanted.destroy()
    return sets


def _array(scalar: pa.Scalar) -> np.ndarray:
    return scalar.values.to_numpy().view(np.uint64)


def _common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each number of a sorted set whether it is in the other one."""
    if not len(right):
        return np.zeros(len(left), dtype=bool)
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    return right[at] == left


def _against_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links with a leader, and what the set has lost and gained against it."""
    for batch in batches:
        rows, lost, gained = [], [], []
        columns = (batch.column(k) for k in ("x", "r", "x_set", "r_set"))
        for x, r, x_set, r_set in zip(*columns):
            own, other = _array(x_set), _array(r_set)
            shared = _common(own, other)
            overlap = int(shared.sum())
            if linked(overlap, len(own), len(other)):
                union = len(own) + len(other) - overlap
                rows.append((x.as_py(), r.as_py(), overlap / union))
                gained.append(own[~shared])
                lost.append(other[~_common(other, own)])
        xs, rs, similarity = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [
                words.arrow(xs, pa.int64()),
                words.arrow(rs, pa.int64()),
                words.arrow(similarity, pa.float64()),
                _lists(lost),
                _lists(gained),
            ],
            ["x", "r", "similarity", "lost", "gained"],
        )


def _commonness(rows: DataFrame, ids: DataFrame, rarity) -> DataFrame:
    """(id, common): mean rank of a set's shingles. Of near copies the least changed is highest."""
    wanted = bit_table(ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            keep = maybe_in(wanted.value, batch.column("row_key").to_numpy())
            chosen = batch.filter(words.arrow(keep))
            means = []
            for text in words.raw_texts(chosen.column("text")):
                shingles = words.shingle_set(text, SHINGLE_WORDS)
                ranks = rarity.value[_counters(shingles)]
                means.append(float(ranks.mean()) if len(ranks) else 0.0)
            yield pa.RecordBatch.from_arrays(
                [chosen.column("row_key"), words.arrow(means, pa.float64())], ["id", "common"]
            )

    found = rows.select("row_key", "text").mapInArrow(task, "id long, common double")
    return found.join(ids, "id", "left_semi")


def leader_links(rows: DataFrame, keys: DataFrame, rarity) -> DataFrame:
    """(x, r, similarity, lost, gained): classes linked with a leader that shares min-hashes.

    Leaders are chosen among sets of one size range, or sets that hold a whole family and more
    would lead it. Two grids of ranges, half a step apart, keep a family from being cut.
    """
    level = F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))
    grids = F.array(F.floor(level) * 2, F.floor(level + 0.5) * 2 + 1)
    own = ["which", "key", "size"]
    keyed = keys.select("id", "n", F.explode(grids).alias("size"), "keys").select(
        "id", "n", "size", F.posexplode("keys").alias("which", "key")
    )
    counts = keyed.groupBy(*own).agg(F.count("*").alias("m")).where("m > 1")
    keyed = written(keyed.join(written(counts, "min-hashes"), own), "shared-keys")
    central = _commonness(rows, written(keyed.select("id").distinct(), "ids"), rarity)
    choice = F.max(F.struct("common", (-F.col("id")).alias("minus_id"), "n")).alias("first")
    leaders = (
        keyed.join(central, "id")
        .groupBy(*own)
        .agg(choice)
        .select(*own, (-F.col("first.minus_id")).alias("r"), F.col("first.n").alias("r_n"))
    )
    pairs = written(
        keyed.join(written(leaders, "leaders"), own)
        .where((F.col("id") != F.col("r")) & linked(F.least("n", "r_n"), F.col("n"), F.col("r_n")))
        .groupBy(F.col("id").alias("x"), "r", "size")
        .count()
        .where(F.col("count") >= SHARED_HASHES)
        .select("x", "r")
        .distinct(),
        "leader-pairs",
    )
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("r")).distinct()
    sets = sets_of(rows, written(ids, "ids"))
    compared = pairs.join(sets.toDF("x", "x_set"), "x").join(sets.toDF("r", "r_set"), "r")
    return written(
        compared.mapInArrow(
            _against_leader,
            "x long, r long, similarity double, lost array<long>, gained array<long>",
        ),
        "leader-links",
    )


def _prefixes(rarity):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            sizes, found = [], []
            for text in words.raw_texts(batch.column("text")):
                shingles = words.shingle_set(text, SHINGLE_WORDS)
                n = len(shingles)
                sizes.append(n)
                length = n - -(-3 * n // 4) + 1 if n else 0
                rare = np.argsort(rarity.value[_counters(shingles)], kind="stable")
                found.append(shingles[rare[:length]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), words.arrow(sizes, pa.int64()), _lists(found)],
                ["id", "n", "prefix"],
            )

    return task


def _entries(wanted):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index entries of shingles that more than one cluster may have."""
        for batch in batches:
            lists = batch.column("prefix")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()[ends[0] : ends[-1]]
            lengths = np.diff(ends)
            row = np.repeat(np.arange(len(batch)), lengths)
            at = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)
            keep = maybe_in(wanted.value, flat)
            row = row[keep]
            yield pa.RecordBatch.from_arrays(
                [words.arrow(flat[keep]), words.arrow(at[keep].astype(np.int32))]
                + [batch.column(k).take(words.arrow(row)) for k in ("id", "cluster", "several", "n")],
                ["token", "at", "id", "cluster", "several", "n"],
            )

    return task


def index_candidates(index: DataFrame) -> DataFrame:
    """(x, y, x_n, y_n): pairs of different clusters that the prefix index cannot rule out."""
    listed = index.select(F.explode("prefix").alias("token"), "cluster")
    shared = written(
        listed.groupBy("token")
        .agg(F.min("cluster").alias("a"), F.max("cluster").alias("b"), F.count("*").alias("m"))
        .where("a < b")
        .select("token", "m"),
        "shared-shingles",
    )
    wanted = bit_table(shared.select("token"))
    entries = index.select("id", "cluster", "several", "n", "prefix").mapInArrow(
        _entries(wanted), "token long, at int, id long, cluster long, several boolean, n long"
    )
    parts = F.greatest(F.lit(1), F.floor(F.col("m") / BLOCK_ENTRIES))
    blocks = written(
        entries.join(shared, "token")
        .withColumn("size_block", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))))
        .withColumn("place", F.floor(F.col("at") * 16 / F.col("n")))
        .withColumn("part", F.pmod(F.xxhash64("id"), parts))
        .withColumn("group", F.when(F.col("several"), F.col("cluster")).otherwise(F.lit(-1)))
        .groupBy("token", "group", "size_block", "place", "part")
        .agg(
            F.min("n").alias("least_n"),
            F.max(F.col("n") - F.col("at")).alias("rest"),
            F.collect_list(F.struct("id", "cluster", "n", "at")).alias("entries"),
        ),
        "index-blocks",
    )
    wanted.destroy()
    name = F.struct("size_block", "place", "part", "group")
    left = blocks.select("token", name.alias("b1"), "least_n", "rest", "entries")
    right = blocks.select(
        "token",
        name.alias("b2"),
        F.col("least_n").alias("least_n2"),
        F.col("rest").alias("rest2"),
        F.col("entries").alias("entries2"),
    )
    possible = (
        (F.col("b1") <= F.col("b2"))
        & (F.col("b2.size_block") - F.col("b1.size_block") <= 1)
        & ((F.col("b1.group") == -1) | (F.col("b1.group") != F.col("b2.group")))
        & linked(F.least("rest", "rest2"), F.col("least_n"), F.col("least_n2"))
    )
    opened = left.join(right, "token").where(possible)
    opened = opened.select("b1", "b2", F.explode("entries").alias("p"), "entries2")
    p, q, ordered = F.col("p"), F.col("q"), F.col("b1") < F.col("b2")

    def fits(other: Column) -> Column:
        rest = F.least(p["n"] - p["at"], other["n"] - other["at"])
        return (
            (p["cluster"] != other["cluster"])
            & (ordered | (p["id"] < other["id"]))
            & linked(rest, p["n"], other["n"])
        )

    opened = opened.select("p", F.explode(F.filter("entries2", fits)).alias("q"))
    x = F.when(p["id"] < q["id"], p).otherwise(q)
    y = F.when(p["id"] < q["id"], q).otherwise(p)
    matches = opened.select(x.alias("x"), y.alias("y")).groupBy(
        F.col("x.id").alias("x"),
        F.col("y.id").alias("y"),
        F.col("x.n").alias("x_n"),
        F.col("y.n").alias("y_n"),
        F.col("x.cluster").alias("x_cluster"),
        F.col("y.cluster").alias("y_cluster"),
    )
    matches = matches.agg(
        F.count("*").alias("m"), F.max("x.at").alias("x_at"), F.max("y.at").alias("y_at")
    )
    rest = F.least(F.col("x_n") - F.col("x_at") - 1, F.col("y_n") - F.col("y_at") - 1)
    return matches.where(linked(F.col("m") + rest, F.col("x_n"), F.col("y_n"))).select(
        "x", "y", "x_n", "y_n", "x_cluster", "y_cluster"
    )


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("r_set"), batch.column("y_set"))
        counts = [int(_common(_array(a), _array(b)).sum()) for a, b in pairs]
        yield pa.RecordBatch.from_arrays(
            [batch.column("r"), batch.column("y"), words.arrow(counts, pa.int64())],
            ["r", "y", "overlap"],
        )


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leader's overlap less what x lost of it, and what x gained."""
    for batch in batches:
        counts = []
        columns = (batch.column(k) for k in ("overlap", "lost", "gained", "y_set"))
        for overlap, lost, gained, other in zip(*columns):
            other = _array(other)
            less = int(_common(_array(lost), other).sum())
            more = int(_common(_array(gained), other).sum())
            counts.append(overlap.as_py() - less + more)
        yield pa.RecordBatch.from_arrays(
            [batch.column(k) for k in ("x", "y", "x_n", "y_n")] + [words.arrow(counts, pa.int64())],
            ["x", "y", "x_n", "y_n", "overlap"],
        )


def cluster_links(candidates: DataFrame, leaders: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): the candidate pairs that are links, from their leaders' overlaps."""
    own = leaders.groupBy("x").agg(
        F.max(F.struct("similarity", -F.col("r"))).alias("best")
    )
    own = own.select("x", (-F.col("best.col2")).alias("r"))
    own = leaders.join(own, ["x", "r"]).select("x", "r", "lost", "gained").dropDuplicates(["x"])
    none = F.array().cast("array<long>")
    pairs = written(
        candidates.join(own, "x", "left").select(
            "x",
            "y",
            "x_n",
            "y_n",
            F.coalesce("r", "x").alias("r"),
            F.coalesce("lost", none).alias("lost"),
            F.coalesce("gained", none).alias("gained"),
        ),
        "candidates",
    )
    bases = written(pairs.select("r", "y").distinct(), "leader-candidates")
    ids = bases.select(F.col("r").alias("id")).union(bases.select("y")).distinct()
    sets = sets_of(rows, written(ids, "ids"))
    overlaps = (
        bases.join(sets.toDF("r", "r_set"), "r")
        .join(sets.toDF("y", "y_set"), "y")
        .mapInArrow(_overlaps, "r long, y long, overlap long")
    )
    known = written(pairs.join(overlaps, ["r", "y"]), "leader-overlaps")
    least = F.col("overlap") - F.size("lost")
    most = F.col("overlap") + F.size("gained")
    n = (F.col("x_n"), F.col("y_n"))
    sure = known.where(linked(least, *n)).select("x", "y")
    open_ = known.where(~linked(least, *n) & linked(most, *n))
    decided = (
        open_.join(sets.toDF("y", "y_set"), "y")
        .mapInArrow(_corrected, "x long, y long, x_n long, y_n long, overlap long")
        .where(linked(F.col("overlap"), *n))
        .select("x", "y")
    )
    return sure.union(decided).toDF("a", "b")


def similarity_classes(docs: DataFrame) -> DataFrame:
    """One row per document: row_key, doc_id, n_shingles, component_id, representative.

    Words are lower-cased in A-Z; a document with fewer than five words is one shingle. Null, empty
    and blank texts have the empty set, are linked with nothing and are their own component; equal
    sets are always linked. ``component_id`` is the smallest doc_id reachable by links (null ids
    count only where there is no other). ``representative`` is true for one row of each component
    and of each empty text: the smallest doc_id, of repeated ids the first row. ``docs`` must give
    the same rows at each reading; columns other than doc_id and text are not looked at.
    """
    docs = stored(docs)
    rows = with_row_key(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"])
    profiles = written(rows.mapInArrow(_profiles, PROFILE), "profiles")
    rarity = docs.sparkSession.sparkContext.broadcast(_rarity(profiles))
    sets = profiles.where("block IS NULL")
    identity = ["n", "set1", "set2"]
    classes = written(
        sets.where("n > 0")
        .groupBy(*identity)
        .agg(F.min("row_key").alias("id"), _first_document().alias("first")),
        "classes",
    )
    keys = sets.join(classes.select("id"), F.col("row_key") == F.col("id"), "left_semi").select(
        F.col("row_key").alias("id"), "n", "keys"
    )
    leaders = leader_links(rows, keys, rarity)
    inner = leaders.select(F.col("x").alias("a"), F.col("r").alias("b"))
    clusters = written(components(inner), "clusters")
    labels = classes.select("id").join(
        clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")),
        "id",
        "left",
    )
    labels = labels.select(
        "id", F.coalesce("cluster", "id").alias("cluster"), F.col("cluster").isNotNull().alias("several")
    )
    index = written(
        rows.select("row_key", "text")
        .mapInArrow(_prefixes(rarity), "id long, n long, prefix array<long>")
        .join(labels, "id"),
        "index",
    )
    rarity.destroy()
    candidates = index_candidates(index)
    between = cluster_links(candidates, leaders, rows)
    joined = components(clusters.toDF("a", "b").union(between))
    members = classes.join(joined.toDF("id", "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    firsts = members.groupBy("component").agg(F.min("first").alias("component_first"))
    answers = written(
        members.join(written(firsts, "component-firsts"), "component").select(
            *identity, "component_first"
        ),
        "class-answers",
    )
    return sets.join(answers, identity, "left").select(
        "row_key",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id"))
        .otherwise(F.col("component_first.doc_id"))
        .alias("component_id"),
        F.coalesce(F.col("row_key") == F.col("component_first.row_key"), F.lit(True)).alias(
            "representative"
        ),
    )


def _first_document() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The representatives with all their columns; ``docs`` must be a stored table."""
    docs = stored(docs)
    return without(docs, similarity_classes(docs).where("NOT representative"))
