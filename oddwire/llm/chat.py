"""Chat training texts from reply trees, with DataFrame functions only.

Every root-to-leaf path of a tree becomes one conversation. Paths are found by self-joins that
double the distance they reach: first each message learns its ancestor at distance 1, 2, 4, ...;
then each leaf collects its ancestors at every distance, from the largest power down, each once.
A tree of depth d takes about 2 log2(d) joins, and no row is made that is not part of a path.

A turn is written ``### role: text</turn>`` and a line feed. Inside texts ``\\`` becomes ``\\\\``,
``##`` becomes ``\\d`` and ``</turn>`` becomes ``\\e`` (in roles also ``:`` becomes ``\\c``), so no
text can hold a mark, and reading the marks back restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddwire.llm.shared import written

HEAD = "### "
MIDDLE = ": "
END = "</turn>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("##"), F.lit("\\d"))
    return F.replace(text, F.lit("</turn>"), F.lit("\\e"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes end nothing, so what is between them holds whole escapes only."""

    def part(piece: Column) -> Column:
        piece = F.replace(piece, F.lit("\\e"), F.lit("</turn>"))
        piece = F.replace(piece, F.lit("\\d"), F.lit("##"))
        return F.replace(piece, F.lit("\\c"), F.lit(":"))

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def ancestors(messages: DataFrame) -> list[DataFrame]:
    """Tables (node, up) of the ancestors at distance 1, 2, 4, ... as long as there are any."""
    known = messages.select(F.col("node").alias("up"))
    step = written(
        messages.where(F.col("parent").isNotNull())
        .select("node", F.col("parent").alias("up"))
        .join(known, "up", "left_semi"),
        "replies",
    )
    total = messages.count()
    steps: list[DataFrame] = []
    while not step.isEmpty():
        if 1 << len(steps) > total:
            raise ValueError("messages that answer each other in a circle")
        steps.append(step)
        further = step.select(F.col("node").alias("up"), F.col("up").alias("further"))
        step = written(
            step.join(further, "up").select("node", F.col("further").alias("up")), "replies"
        )
    return steps


def paths(messages: DataFrame) -> DataFrame:
    """(leaf, node, distance): every message on the way from each leaf to its root."""
    steps = ancestors(messages)
    parents = messages.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    found = messages.join(parents, "node", "left_anti").select(
        F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance")
    )
    for level, step in reversed(list(enumerate(steps))):
        above = found.join(step, "node").select(
            "leaf", F.col("up").alias("node"), F.col("distance") + F.lit(1 << level)
        )
        found = written(found.union(above), "paths")
    return found


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One formatted conversation per chosen path: tree, leaf, rank, score, formatted, loss_spans.

    ``messages`` has tree, node (unique, not null), parent (null or unknown: a root), role, text
    and score; null role, text and score count as empty and 0. A path's score is the sum of its
    messages' scores. Paths are ranked within their tree by score, ties by leaf; ``branches`` keeps
    the best of each tree. ``loss_spans`` are the byte ranges of the assistant texts. An empty table
    gives no rows; circles of replies are an error.
    """
    messages = written(
        messages.select(
            "tree",
            "node",
            "parent",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        ),
        "messages",
    )
    steps = paths(messages).join(messages, "node")
    if branches is not None:
        ranked = steps.groupBy("tree", "leaf").agg(F.sum("score").alias("total"))
        best = Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")
        chosen = ranked.withColumn("place", F.row_number().over(best)).where(
            F.col("place") <= branches
        )
        steps = steps.join(chosen.select("leaf"), "leaf", "left_semi")
    head = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(MIDDLE))
    turns = steps.select(
        "tree", "leaf", "distance", "role", "score", head.alias("head"), escape(F.col("text")).alias("body")
    ).withColumn("whole", F.concat("head", "body", F.lit(END)))
    way = Window.partitionBy("leaf").orderBy(F.desc("distance"))
    start = F.sum(F.octet_length("whole")).over(way) - F.octet_length(F.concat("body", F.lit(END)))
    turns = turns.withColumn("start", start).withColumn(
        "span",
        F.when(
            F.col("role") == "assistant",
            F.struct(
                F.col("start").cast("int").alias("start"),
                (F.col("start") + F.octet_length("body")).cast("int").alias("end"),
            ),
        ),
    )
    order = F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("at"), "whole", "span")))
    joined = turns.groupBy("leaf").agg(
        F.first("tree").alias("tree"), F.sum("score").alias("score"), order.alias("turns")
    )
    texts = joined.select(
        "tree",
        "leaf",
        "score",
        F.array_join("turns.whole", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )
    rank = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    return texts.withColumn("rank", F.row_number().over(rank))


def turns_of(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: an array of (role, text)."""
    pieces = F.split(formatted, END, -1)

    def turn(piece: Column) -> Column:
        at = F.locate(MIDDLE, piece)
        role = F.substring(piece, F.lit(len(HEAD) + 1), at - F.lit(len(HEAD) + 1))
        text = F.substring(piece, at + F.lit(len(MIDDLE)), F.char_length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""

    def part(span: Column) -> Column:
        length = span["end"] - span["start"]
        piece = F.substring(formatted.cast("binary"), span["start"] + 1, length)
        return unescape(piece.cast("string"))

    return F.array_join(F.transform(spans, part), "")


def linear_trees(rows: DataFrame) -> DataFrame:
    """Conversations of rows by turn as trees without branches.

    Rows of equal turn are ordered by role and text; a null turn comes first. A null conv_id is a
    conversation of its own.
    """
    way = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(way).alias("n"))
    tree = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("none"))
    return numbered.select(
        F.col("conv_id").alias("tree"),
        F.concat_ws("/", tree, F.col("n")).alias("node"),
        F.when(F.col("n") > 1, F.concat_ws("/", tree, F.col("n") - 1)).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )
