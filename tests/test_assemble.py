import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from oddwire.operators import assemble, features, parse, statistics
from oddwire.sources.traffic import log_name, named_line, read_lines, read_requests, union_sets
from table_queries import derived
from traffic_samples import BROWSER, expected, request, shop_traffic


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture
def small_splits(spark):
    saved = {
        key: spark.conf.get(key)
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    }

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for key, value in saved.items():
        spark.conf.set(key, value)


def found(requests):
    rows = requests.orderBy("line_no").collect()
    return [
        {
            "line_no": r["line_no"], "id": r["id"],
            "line": f"{r['method']} {r['uri']} {r['standard']}", "headers": r["headers"], "body": r["body"],
        }
        for r in rows
    ]


@pytest.mark.parametrize("size", ["128m", "4000", "700", "90"])
def test_requests_do_not_depend_on_splits(spark, tmp_path, small_splits, size):
    lines = shop_traffic(3, 40)
    # One request longer than several splits, and a repeated header.
    long_body = [f"part {i} " + "y" * 50 for i in range(60)]
    lines += request("POST http://h/long HTTP/1.1", [*BROWSER, "Pragma: twice"], long_body)
    lines += shop_traffic(4, 10)
    path = write(tmp_path, "a.txt", lines)
    small_splits(size)
    if size == "90":
        assert read_lines(spark, path).select("split").distinct().count() > 50
    got = found(read_requests(spark, path))
    assert got == expected(lines)
    assert any(r["id"] != r["line_no"] for r in got)


def test_ids_restart_in_every_file(spark, tmp_path):
    one, two = shop_traffic(1, 5), shop_traffic(2, 7)
    paths = [write(tmp_path, "one.txt", one), write(tmp_path, "two.txt", two)]
    rows = read_requests(spark, *paths, label="normal").groupBy("file").agg(
        F.min("id").alias("first"), F.count("*").alias("n"), F.first("label").alias("label")
    ).orderBy("file").collect()
    assert [(r["first"], r["n"], r["label"]) for r in rows] == [(1, 5, "normal"), (1, 7, "normal")]


def test_last_request_may_lack_its_blank_lines(spark, tmp_path):
    lines = request("GET http://h/a HTTP/1.1", BROWSER) + ["GET http://h/b HTTP/1.1", "Host: h"]
    got = read_requests(spark, write(tmp_path, "a.txt", lines)).orderBy("id").collect()
    assert [(r["path"], r["body"]) for r in got] == [("/a", ""), ("/b", "")]


def test_windows_line_ends(spark, tmp_path):
    path = tmp_path / "crlf.txt"
    path.write_bytes("\r\n".join(request("GET http://h/a HTTP/1.1", BROWSER, ["x=1", "y"])).encode())
    row = read_requests(spark, str(path)).first()
    assert (row["path"], row["body"], len(row["headers"])) == ("/a", "x=1\ny", len(BROWSER))


BAD = {
    "request_line": request("GET http://h/a b HTTP/1.1", BROWSER),
    "header_key": request("GET http://h/a HTTP/1.1", [": x"]),
    "header_value": request("GET http://h/a HTTP/1.1", ["Host:"]),
    "parameter_key": request("GET http://h/a?x=1&&y=2 HTTP/1.1", BROWSER),
}


@pytest.mark.parametrize("reason", BAD)
def test_malformed_requests(spark, tmp_path, reason):
    lines = shop_traffic(1, 3) + BAD[reason] + shop_traffic(2, 3)
    path = write(tmp_path, "bad.txt", lines)
    kept = read_requests(spark, path, mode="PERMISSIVE")
    assert parse.well_formed(kept).count() == 6
    assert [r["_corrupt_reason"] for r in parse.quarantined(kept).collect()] == [reason]
    with pytest.raises(Exception, match=f"rule {reason}"):
        read_requests(spark, path).collect()


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        parse.parse_requests(spark.range(1), mode="DROPMALFORMED")


def test_offsets_missing_for_a_split_fail(spark, monkeypatch):
    lines = spark.createDataFrame([("f", 0, 0, "x"), ("f", 9, 0, "y")], "file string, split long, seq long, value string")
    whole = assemble.split_offsets(lines)
    monkeypatch.setattr(assemble, "split_offsets", lambda _: whole.where("split = 0"))
    with pytest.raises(Exception, match="input splits changed"):
        assemble.number_lines(lines).collect()


def test_union_keeps_duplicates(spark):
    one = spark.createDataFrame([(1, "a")], "id int, label string")
    assert union_sets(one, one, one).count() == 3


def test_text_is_exchanged_once(spark, tmp_path):
    """The ids read the exchanged lines again, not the files."""
    path = write(tmp_path, "a.txt", shop_traffic(1, 5))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        requests = read_requests(spark, path)
        plan = requests._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan text") == 1
    assert plan.count("ReusedExchange") == 1
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    with_text = [line for line in exchanges if "Reused" not in line]
    # The text, and the small table of where the requests of a split end.
    assert len(with_text) == 2 and "_end" not in with_text[0]


def assembled(spark, rows):
    lines = spark.createDataFrame(rows, "file string, split long, seq long, value string")
    return assemble.assemble_requests(lines.repartition(4, "value"))


@pytest.mark.parametrize("seed", range(6))
def test_any_cut_gives_the_same_requests(spark, seed):
    """Random blank lines, cut into splits of random length, also of one line."""
    draw = random.Random(seed)
    rows, wanted = [], []
    for file in "abc":
        values = [draw.choice(["", f"{file}{k}", f"{file}{k}", f"{file}{k}"]) for k in range(draw.randint(1, 60))]
        split, seq = draw.randint(0, 5), 0
        for value in values:
            if seq and draw.random() < 0.3:
                split, seq = split + draw.randint(1, 9), 0
            rows.append((file, split, seq, value))
            seq += 1
        request, blanks = {}, 0
        for number, value in enumerate(values, 1):
            own = request.setdefault(blanks // 2, (number, [], []))
            if value:
                own[1 + blanks % 2].append(value)
            blanks += value == ""
        wanted += [(file, no, *own) for no, own in request.items()]
    found = [
        (r["file"], r["request_no"], r["line_no"], r["head"], r["body_lines"])
        for r in assembled(spark, rows).collect()
    ]
    assert sorted(found) == sorted(wanted)


def test_homes_of_one_request_over_many_splits(spark):
    values = ["POST", "A: 1", "B: 2", "", "x", "y", "z", "", "GET", "C: 3"]
    rows = [("f", split, 0, value) for split, value in enumerate(values)]
    found = sorted(tuple(r) for r in assembled(spark, rows).collect())
    assert found == [
        ("f", 3, 0, 1, ["POST", "A: 1", "B: 2"], ["x", "y", "z"]),
        ("f", 9, 1, 9, ["GET", "C: 3"], []),
    ]


def test_empty_line_table(spark):
    assert assembled(spark, []).count() == 0


@pytest.fixture
def partitions(spark):
    key = "spark.sql.files.minPartitionNum"
    saved = spark.conf.get(key, None)
    yield lambda number: spark.conf.set(key, str(number))
    spark.conf.unset(key) if saved is None else spark.conf.set(key, saved)


@pytest.mark.parametrize("number", [2, 7, 8])
@pytest.mark.parametrize("split_lines", [3, 1 << 18])
def test_compressed_and_plain_files(spark, tmp_path, partitions, small_splits, number, split_lines):
    """Lines are known by their place in the file, however the scan packs files into tasks."""
    sets = {f"{k}.txt": shop_traffic(k, 15 + 4 * k) for k in range(6)}
    for name, lines in sets.items():
        text = "\n".join(lines) + "\n"
        if name < "3":
            (tmp_path / f"{name}.gz").write_bytes(gzip.compress(text.encode()))
        else:
            (tmp_path / name).write_text(text, encoding="utf-8")
    small_splits("20000")
    partitions(number)
    requests = read_requests(spark, str(tmp_path), split_lines=split_lines).withColumn(
        "name", F.regexp_extract("file", r"(\d\.txt)", 1)
    )
    for name, lines in sets.items():
        assert found(requests.where(F.col("name") == name)) == expected(lines)
    if split_lines == 3:
        lines = read_lines(spark, str(tmp_path), split_lines=3)
        sizes = lines.groupBy("file", "split").agg(
            F.count("*").alias("n"), (F.max("seq") - F.min("seq") + 1).alias("reach")
        )
        assert sizes.where("n > 3 OR n <> reach").count() == 0 and sizes.count() > 100


@pytest.mark.parametrize("shift", [-1, 1])
def test_a_scan_packed_otherwise_fails(spark, tmp_path, monkeypatch, shift):
    lines = read_lines(spark, write(tmp_path, "a.txt", shop_traffic(2, 30)))
    offsets = assemble.split_offsets(lines)
    monkeypatch.setattr(assemble, "split_offsets", lambda _: offsets)
    with pytest.raises(Exception, match="input splits changed"):
        assemble.number_lines(lines.withColumn("seq", F.col("seq") + shift)).collect()


def test_cores_lost_between_two_scans(spark, tmp_path, small_splits):
    """The first load fixes how files are cut, so a later scan of them is cut alike."""
    path = write(tmp_path, "a.txt", shop_traffic(2, 60))
    key = "spark.sql.files.minPartitionNum"
    spark.conf.unset(key)
    small_splits("128m")
    requests = read_requests(spark, path)
    assert spark.conf.get(key) == str(spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert found(requests) == expected(shop_traffic(2, 60))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


@pytest.mark.parametrize(
    "broken",
    [
        ["GET http://h/with space HTTP/1.1", "Host: h"],
        ["GET http://h/a HTTP/1.1", ": no key"],
        ["GET http://h/a HTTP/1.1", "Host:"],
        ["GET http://h/a?x=1&&y=2 HTTP/1.1", "Host: h"],
    ],
)
def test_failfast_fails_whatever_is_read(spark, tmp_path, broken):
    good = ["GET http://h/b HTTP/1.1", "Host: h"]
    path = tmp_path / "traffic.txt"
    path.write_text("\n".join([*good, "", "", *broken, "", ""]) + "\n", encoding="utf-8")
    requests = read_requests(spark, str(path), label="normal")
    for use in (
        statistics.request_count(requests),
        statistics.distinct_counts(statistics.distinct_values(requests)),
        features.header_features(requests),
        features.parameter_features(requests),
        requests.select("id", "path"),
        requests.groupBy().count(),
    ):
        with pytest.raises(Exception, match="malformed request"):
            use.collect()
    assert read_requests(spark, str(path), label="n", mode="PERMISSIVE").count() == 2


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("size", ["128m", "700"])
def test_many_logs_in_one_file(spark, tmp_path, small_splits, packed, size):
    sets = {f"shop é#{k}\tx": shop_traffic(k, 5 + k) for k in range(12)}
    rows = [(name, n, line) for name, lines in sets.items() for n, line in enumerate(lines)]
    path = str(tmp_path / "logs")
    logs = spark.createDataFrame(rows, "name string, n long, line string").coalesce(1)
    logs = logs.sortWithinPartitions("name", "n")
    logs.select(named_line(F.col("name"), F.col("line"))).write.option(
        "compression", "gzip" if packed else "none"
    ).text(path)
    small_splits(size)
    requests = read_requests(spark, path, split_lines=20, named=True)
    requests = requests.withColumn("name", log_name(F.col("file"))).cache()
    assert requests.select("file").distinct().count() == len(sets)
    for name, lines in sets.items():
        assert found(requests.where(F.col("name") == name)) == expected(lines)


def test_line_without_the_name_of_its_log_fails(spark, tmp_path):
    path = write(tmp_path, "a.txt", ["a\tGET / HTTP/1.1", "a\t", "GET / HTTP/1.1"])
    with pytest.raises(Exception, match="without the name of its log"):
        read_lines(spark, path, named=True).collect()


def test_files_of_pages_do_not_grow_with_their_logs(spark, tmp_path):
    rows = [
        (k, f"http://{'blog' if k % 3 else 'www'}{k % 7}.example.org/en/{k}?page={k}", f"<title>t{k}</title>\n{k} x\n\ny")
        for k in range(0, 2000, 5)
    ]
    rows += [
        (1, "http://blog1.example.org/a", "one\rtwo\r\nthree\r\r\n\rfour"),
        (2, "http://blog1.example.org/b", "<title>two\nlines\r</title>\n"),
        (3, "http://blog1.example.org/c", ""),
        (3, "http://blog1.example.org/c", ""),
        (4, "http://blog1.example.org/d", None),
        (5, None, "text"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(
        str(tmp_path / "pages.parquet")
    )
    sf_dir = str(tmp_path)
    logs: dict = {}
    for r in derived.page_traffic(spark, sf_dir).orderBy("page_id").collect():
        if r["lines"] is not None and r["host"] is not None:
            name = f"{r['host']}-{r['page_id'] // derived.FILE_PAGES}"
            logs[name] = logs.get(name, "") + "".join(f"{line}\n" for line in r["lines"])
    assert len(logs) > 300
    (tmp_path / "each").mkdir()
    for name, text in logs.items():
        (tmp_path / "each" / name).write_bytes(text.encode())
    root = derived.page_files(spark, sf_dir)
    files = list(Path(root).rglob("part-*"))
    assert 0 < len(files) <= 16
    assert {f.name.endswith(".gz") for f in files} == {True, False}

    def plain(requests):
        columns = ["name", "request_no", "line_no", "id", "uri", "headers", "body"]
        return sorted((tuple(r) for r in requests.select(columns).collect()), key=str)

    each = read_requests(spark, str(tmp_path / "each"), mode="PERMISSIVE")
    each = each.withColumn("name", F.regexp_extract("file", "([^/]*)$", 1))
    together = read_requests(spark, root, split_lines=100, named=True, mode="PERMISSIVE")
    together = together.withColumn("name", log_name(F.col("file")))
    assert plain(together) == plain(each)
