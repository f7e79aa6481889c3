"""Network connection records: quarantine, attack classes and traffic features.

A host or a service may take a large part of all connections, so no window spans a whole
host or service. Time windows are running sums of rows that enter and leave, cut into time
slices that begin with what the earlier ones left over. Windows of the last n connections are
cut into blocks of ranks; rows near a border are copied into the next block as context and
dropped again afterwards, so every frame is complete.

A frame may hold very many rows of a hot service. Its sums are therefore differences of two
running sums, each of which sees every row once, rather than a sliding frame that is added
up anew for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddwire.schema import ATTACK_CLASSES, CONNECTIONS, NORMAL


def quarantine_connections(lines: DataFrame) -> DataFrame:
    """Connection columns of a table of lines (``value``), and why a line is unusable.

    ``_corrupt_reason`` is ``field_count`` for any other number of fields than 42 and
    ``number`` for a continuous field that is none; that field is null, and all fields are
    where the count is wrong. An empty field is null and no error.
    """
    names = CONNECTIONS.fieldNames()
    symbolic = [at for at, f in enumerate(CONNECTIONS) if not isinstance(f.dataType, T.DoubleType)]
    # Every field is read once, in arrays; generated code would be too long to be compiled.
    parts = lines.select("value", F.split("value", ",").alias("_parts"))
    whole = F.when(F.size("_parts") == len(names), F.col("_parts"))
    read = parts.select("value", whole.alias("_parts")).select(
        "*", F.transform("_parts", lambda part: part.try_cast("double")).alias("_numbers")
    )
    unread = F.zip_with("_parts", "_numbers", lambda part, x: x.isNull() & (part != ""))
    broken = F.size(F.filter(unread, lambda bad, at: bad & ~at.isin(symbolic))) > 0
    fields = [
        F.nullif(F.get("_parts", F.lit(at)), F.lit("")) if at in symbolic else F.get("_numbers", F.lit(at))
        for at in range(len(names))
    ]
    return read.select(
        *[field.alias(name) for field, name in zip(fields, names)],
        "value",
        F.when(F.col("_parts").isNull(), "field_count").when(broken, "number").alias("_corrupt_reason"),
    )


def attack_class(label: Column) -> Column:
    """Class of an attack name, with or without its final dot; null for an unknown name."""
    classes = F.create_map(*[F.lit(x) for pair in ATTACK_CLASSES.items() for x in pair])
    name = F.rtrim(label, F.lit("."))
    return F.when(name == NORMAL, NORMAL).otherwise(F.try_element_at(classes, name))


def with_attack_class(connections: DataFrame, label: str = "label") -> DataFrame:
    return connections.withColumn("attack_class", attack_class(F.col(label)))


def _micros(table: DataFrame, ts: str) -> Column:
    if isinstance(table.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(ts)


def _trailing(value: Column, keys: list[str], order: str, span: int) -> Column:
    """Sum of a column over the rows of the keys whose order value is at most ``span`` less
    than the current one, equal ones included."""
    rows = Window.partitionBy(*keys).orderBy(order)
    until_here = F.sum(value).over(rows.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    too_early = F.sum(value).over(rows.rangeBetween(Window.unboundedPreceding, -(span + 1)))
    return until_here - F.coalesce(too_early, F.lit(0))


def _rate(part: Column, total: Column) -> Column:
    return part.cast("double") / total


def _running(
    rows: DataFrame, key: str, measures: dict[str, tuple[list[str], Column]], span: int, width: int
) -> DataFrame:
    """Add sums over the rows of the same keys whose ``_us`` is at most ``span`` less.

    ``measures`` names each sum, the keys beside ``key`` that it is kept for, and what is summed.
    A row enters at its time and leaves just after its time plus the span, so what is inside is
    a running sum of both. Sums run inside time slices of any width, by (key, slice); each slice
    begins with a row of what the slices before it have left over.
    """
    names = list(measures)
    own = list(dict.fromkeys(k for keys, _ in measures.values() for k in keys))
    none = {n: F.lit(0).cast("long") for n in names}
    known = rows.where("_us IS NOT NULL")

    def events(table: DataFrame, sign: int, delay: int, *kept: str) -> DataFrame:
        time = F.col("_us") + delay
        return table.select(
            *kept,
            key,
            *own,
            time.alias("_time"),
            F.floor(time / width).alias("_slice"),
            *[(sign * c).cast("long").alias(n) for n, (_, c) in measures.items()],
        )

    inside = events(rows, 1, 0, F.struct(*[F.col(c) for c in rows.columns]).alias("_row"))
    moves = events(known, 1, 0).unionByName(events(known, -1, span + 1))
    stream = inside.unionByName(events(known, -1, span + 1), allowMissingColumns=True)
    for keys in {tuple(keys) for keys, _ in measures.values()}:
        sums = [n for n, (k, _) in measures.items() if tuple(k) == keys]
        counts = moves.groupBy(key, *keys, "_slice").agg(*[F.sum(n).alias(n) for n in sums])
        earlier = (
            Window.partitionBy(key, *keys)
            .orderBy("_slice")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = counts.select(
            key,
            *keys,
            *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in own if k not in keys],
            (F.col("_slice") * width).alias("_time"),
            "_slice",
            *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) if n in sums else none[n].alias(n) for n in names],
        )
        stream = stream.unionByName(carried, allowMissingColumns=True)

    def total(name: str) -> Column:
        until_here = (
            Window.partitionBy(key, "_slice", *measures[name][0])
            .orderBy("_time")
            .rangeBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return F.sum(name).over(until_here).alias(name)

    summed = stream.select("_row", *map(total, names)).where("_row IS NOT NULL")
    return summed.select("_row.*", *names)


def recent_traffic(
    connections: DataFrame,
    host: str,
    service: str,
    ts: str,
    serror: Column,
    rerror: Column,
    seconds: int = 2,
    slice_seconds: int = 60,
) -> DataFrame:
    """Same-host and same-service features over the past seconds, ends included.

    Adds count, serror_rate, rerror_rate, same_srv_rate, diff_srv_rate (connections to the
    same host) and srv_count, srv_serror_rate, srv_rerror_rate, srv_diff_host_rate
    (connections to the same service). Two shuffles, by (host, slice) and (service, slice);
    slices may be shorter than the window. Rows without a time are counted among themselves.
    """
    width, span = slice_seconds * 1_000_000, seconds * 1_000_000
    timed = connections.select(
        "*",
        _micros(connections, ts).alias("_us"),
        F.coalesce(serror, F.lit(False)).cast("int").alias("_serror"),
        F.coalesce(rerror, F.lit(False)).cast("int").alias("_rerror"),
    )
    one = F.lit(1)
    by_host = _running(
        timed,
        host,
        {
            "count": ([], one),
            "_host_serror": ([], F.col("_serror")),
            "_host_rerror": ([], F.col("_rerror")),
            "_both": ([service], one),
        },
        span,
        width,
    )
    by_service = _running(
        by_host,
        service,
        {
            "srv_count": ([], one),
            "_srv_serror": ([], F.col("_serror")),
            "_srv_rerror": ([], F.col("_rerror")),
        },
        span,
        width,
    )
    host_count, srv_count = F.col("count"), F.col("srv_count")
    same = F.col("_both")
    return by_service.select(
        *connections.columns,
        "count",
        _rate(F.col("_host_serror"), host_count).alias("serror_rate"),
        _rate(F.col("_host_rerror"), host_count).alias("rerror_rate"),
        _rate(same, host_count).alias("same_srv_rate"),
        _rate(host_count - same, host_count).alias("diff_srv_rate"),
        "srv_count",
        _rate(F.col("_srv_serror"), srv_count).alias("srv_serror_rate"),
        _rate(F.col("_srv_rerror"), srv_count).alias("srv_rerror_rate"),
        _rate(srv_count - same, srv_count).alias("srv_diff_host_rate"),
    )


def _ranked(
    table: DataFrame, key: str, order: list[str], n: int, block_rows: int, counted: DataFrame
) -> DataFrame:
    """Rank the rows of each key in order, and place them in blocks of ranks.

    Adds ``_rank`` (from 1), ``_block`` and ``_subject``; the last n - 1 rows of a block are
    repeated in the next one with ``_subject`` false. The rank is the number of rows in
    earlier time slices plus the rank inside the slice. ``counted`` has the same rows with key
    and slice, at less cost than the table itself.
    """
    # As a struct the pair is never null itself, so rows without key or time keep their place.
    group = F.struct(F.col(key).alias("key"), F.col("_slice").alias("slice")).alias("_group")
    grouped = table.select("*", group)
    counts = counted.select(group).groupBy("_group").agg(F.count("*").alias("_n"))
    earlier = (
        Window.partitionBy("_group.key")
        .orderBy("_group.slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        "_group", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_group").orderBy(*order)
    ranked = grouped.join(offsets, "_group").withColumn(
        "_rank", F.col("_offset") + F.row_number().over(inside)
    )
    block = F.floor((F.col("_rank") - 1) / block_rows)
    own = F.struct(block.alias("_block"), F.lit(True).alias("_subject"))
    ahead = F.struct((block + 1).alias("_block"), F.lit(False).alias("_subject"))
    near_end = (F.col("_rank") - 1) % block_rows > block_rows - n
    copies = F.when(near_end, F.array(own, ahead)).otherwise(F.array(own))
    return (
        ranked.drop("_group", "_offset").withColumn("_copies", copies).select("*", F.inline("_copies")).drop("_copies")
    )


def last_connections(
    connections: DataFrame,
    host: str,
    service: str,
    ts: str,
    id: str,
    serror: Column,
    rerror: Column,
    src_port: str | None = None,
    n: int = 100,
    slice_seconds: int = 3600,
    block_rows: int = 10_000,
) -> DataFrame:
    """Features over the last n connections to the same host, the current one included.

    Adds the ten dst_host_* columns. dst_host_srv_diff_host_rate looks at the last n
    connections to the same service, since those to one host have no other host among them.
    Without a source port its rate is null.
    """
    if block_rows < n:
        raise ValueError("a block must hold at least n rows")
    timed = connections.select(
        "*",
        _micros(connections, ts).alias("_us"),
        serror.cast("int").alias("_serror"),
        rerror.cast("int").alias("_rerror"),
    ).withColumn("_slice", F.floor(F.col("_us") / (slice_seconds * 1_000_000)))
    order = ["_us", id]

    def last(value: str | Column, *keys: str) -> Column:
        """Sum over the rows of the keys among the last n ranks."""
        column = F.col(value) if isinstance(value, str) else value
        return _trailing(column, [*keys, "_block"], "_rank", n - 1)

    one = F.lit(1)
    by_host = _ranked(timed, host, order, n, block_rows, timed)
    same_port = last(one, host, src_port) if src_port else F.lit(None).cast("long")
    host_part = by_host.select(
        "*",
        last(one, host).alias("dst_host_count"),
        last("_serror", host).alias("_host_serror"),
        last("_rerror", host).alias("_host_rerror"),
        last(one, host, service).alias("dst_host_srv_count"),
        last("_serror", host, service).alias("_both_serror"),
        last("_rerror", host, service).alias("_both_rerror"),
        same_port.alias("_same_port"),
    ).where("_subject").drop("_rank", "_block", "_subject")
    by_service = _ranked(host_part, service, order, n, block_rows, timed)
    both_parts = by_service.select(
        "*",
        last(one, service).alias("_srv"),
        last(one, service, host).alias("_srv_host"),
    ).where("_subject")
    count, srv_count = F.col("dst_host_count"), F.col("dst_host_srv_count")
    return both_parts.select(
        *connections.columns,
        "dst_host_count",
        "dst_host_srv_count",
        _rate(srv_count, count).alias("dst_host_same_srv_rate"),
        _rate(count - srv_count, count).alias("dst_host_diff_srv_rate"),
        _rate(F.col("_same_port"), count).alias("dst_host_same_src_port_rate"),
        _rate(F.col("_srv") - F.col("_srv_host"), F.col("_srv")).alias("dst_host_srv_diff_host_rate"),
        _rate(F.col("_host_serror"), count).alias("dst_host_serror_rate"),
        _rate(F.col("_both_serror"), srv_count).alias("dst_host_srv_serror_rate"),
        _rate(F.col("_host_rerror"), count).alias("dst_host_rerror_rate"),
        _rate(F.col("_both_rerror"), srv_count).alias("dst_host_srv_rerror_rate"),
    )
