"""Lines to requests, on files cut into splits.

Blank lines alternate: the first ends a head (request line and headers), the second ends a
body, and so on. The request of a line thus follows from the number of blank lines before
it in the file. A window over a whole file would be one task per file, so the count is
taken in two steps: counts per split, summed over the splits of a file (one small row per
split), then a running count where a request is put together.

The text crosses the network once. A request is put together in its home, the split that
holds the blank line behind its head, and the home of a line is known before the exchange:
only what stands before the first or behind the last blank line of a split can belong to a
request of another split, and the number of blank lines up to there tells whether it does.
Lines are therefore hashed by file and home, numbered and grouped there, and all that
follows, up to the request table with its ids, is keyed by the same pair and stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddwire.session import materialise

SPLIT = ["file", "split"]
#: Splits up to which their table, a hundred bytes each, is sent to every task.
BROADCAST_SPLITS = 1_000_000


def split_offsets(lines: DataFrame) -> DataFrame:
    """One row per split: lines and blank lines of the file before it, where its first and
    last blank lines are, and the homes of what stands before and behind them.

    A home is a struct of a split and the number of the first request put together there.
    """
    blank = F.col("value") == ""
    blank_at = F.when(blank, F.col("seq"))
    counts = lines.groupBy(*SPLIT).agg(
        F.min("seq").alias("first_seq"),
        F.count("*").alias("lines"),
        F.count_if(blank).alias("blanks"),
        F.min(blank_at).alias("first_blank"),
        F.max(blank_at).alias("last_blank"),
    )
    in_file = Window.partitionBy("file")
    earlier = in_file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    later = in_file.orderBy(F.desc("split")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(
        "*",
        F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("line_offset"),
        F.coalesce(F.sum("blanks").over(earlier), F.lit(0)).alias("blank_offset"),
    )
    home = F.struct("split", F.ceil(F.col("blank_offset") / 2).alias("first_request"))
    with_blanks = F.when(F.col("blanks") > 0, home)
    return placed.select(
        *SPLIT,
        "first_seq",
        "lines",
        "line_offset",
        "blank_offset",
        "blanks",
        "first_blank",
        "last_blank",
        home.alias("own_home"),
        F.last(with_blanks, ignorenulls=True).over(earlier).alias("home_before"),
        # Without any blank line to come, the rest of the file is one request in its last split.
        F.coalesce(
            F.last(with_blanks, ignorenulls=True).over(later), F.max(home).over(in_file)
        ).alias("home_after"),
    )


def _home() -> Column:
    """Where the request of a line is put together."""
    in_body = F.col("blank_offset") % 2 == 1
    leads = F.col("first_blank").isNull() | (F.col("seq") <= F.col("first_blank"))
    trails = F.col("last_blank").isNull() | (F.col("seq") > F.col("last_blank"))
    ends_in_body = (F.col("blank_offset") + F.col("blanks")) % 2 == 1
    return (
        F.when(in_body & leads, F.col("home_before"))
        .when(~ends_in_body & trails, F.col("home_after"))
        .otherwise(F.col("own_home"))
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Every line with its number in the file (``line_no``, from 1), and ``home``."""
    offsets = materialise(split_offsets(lines))
    if offsets.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    # Both reads cut the files alike. Should one ever be cut differently, some line is in no
    # split or outside its lines: fail rather than number it from the wrong offset.
    place = F.col("seq") - F.col("first_seq")
    fits = F.coalesce((place >= 0) & (place < F.col("lines")), F.lit(False))
    message = F.lit("input splits changed between two scans of the same files")
    place = F.when(fits, place).otherwise(F.raise_error(message).cast("long"))
    return lines.join(offsets, SPLIT, "left").select(
        "file",
        "value",
        (place + F.col("line_offset") + 1).alias("line_no"),
        _home().alias("home"),
    )


def _numbered_lines(condition: Column) -> Column:
    """The lines of a group that meet the condition, in order."""
    pairs = F.sort_array(F.collect_list(F.when(condition, F.struct("line_no", "value"))))
    return F.transform(pairs, lambda pair: pair["value"])


def assemble_requests(lines: DataFrame) -> DataFrame:
    """Requests of a line table (file, split, seq, value); seq counts the lines of a split.

    One row per request: ``request_no`` (from 0) in the file, ``split`` that ends its head,
    ``line_no`` of its request line, ``head`` (array of lines, the request line first) and
    ``body_lines`` (array). A group is one request, never a file.
    """
    numbered = number_lines(lines).select(
        "file",
        # Never null, and seen to be: no filter comes between the two reads of the exchange.
        F.coalesce("home.split", F.lit(-1).cast("long")).alias("split"),
        F.col("home.first_request").alias("first_request"),
        "line_no",
        "value",
    )
    before = (
        Window.partitionBy(*SPLIT).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    )
    blanks = F.coalesce(F.sum((F.col("value") == "").cast("long")).over(before), F.lit(0))
    sections = numbered.select(*SPLIT, "first_request", "line_no", "value", blanks.alias("section"))
    text = F.col("value") != ""
    in_body = F.col("section") % 2 == 1
    request_no = F.col("first_request") + F.floor(F.col("section") / 2)
    return sections.groupBy(*SPLIT, request_no.alias("request_no")).agg(
        F.min("line_no").alias("line_no"),
        _numbered_lines(text & ~in_body).alias("head"),
        _numbered_lines(text & in_body).alias("body_lines"),
    )


def assign_ids(requests: DataFrame) -> DataFrame:
    """Add ``id``: the line number at which a request is expected to begin.

    A request is taken to have as many lines as distinct headers and at most one body line,
    so the id falls behind the true line number once a file repeats a header or has a body
    of several lines. Ids begin at 1 in every file.

    As with lines, the running sum is split in two: a window inside each split, and offsets
    from a small table that holds where the requests of each split end.
    """
    predicted = (1 + F.size("headers") + F.when(F.col("body") == "", 2).otherwise(3)).cast("long")
    in_split = Window.partitionBy(*SPLIT).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sized = requests.withColumn("_lines", predicted)
    placed = sized.withColumn("_start", F.coalesce(F.sum("_lines").over(in_split), F.lit(0)))
    ends = placed.groupBy(*SPLIT).agg(F.max(F.col("_start") + F.col("_lines")).alias("_end"))
    offsets = ends.select(
        *SPLIT, F.coalesce(F.sum("_end").over(in_file), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(offsets, SPLIT)
        .withColumn("id", 1 + F.col("_offset") + F.col("_start"))
        .drop("_lines", "_start", "_offset")
    )
