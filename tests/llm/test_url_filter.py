import random

import pytest

from oddwire.llm import url_filter

SCHEMA = "page_id long, url string, host string, path string, rule string, best int, at string"


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]


def brute(url, rules, default):
    host, path = cut(url)
    fits = [
        (len(h) + len(p), len(h), h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def judged(spark, urls, rules, tmp_path, default="allow"):
    path = str(tmp_path / "pages")
    wide = [(k, url, "h", "p", "r", 1, "a") for k, url in enumerate(urls)]
    spark.createDataFrame(wide, SCHEMA).repartition(3).write.parquet(path)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    made = url_filter.judge(spark.read.parquet(path), table, "page_id", default).drop("row_key")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in made.collect()}
    assert made.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert len(rows) == len(urls)
    return [rows[k] for k in range(len(urls))]


ODD = [
    None, "", "x", "://", "http://", "http:///a", "http://com", "http://com/", "HTTP://A.COM/x?y#z",
    "http://a.com?x/", "http://a.com#/en/", "ftp://u@b.com:80/en/", "a://b://c.com/", "http://..com/en/",
    "http://É.com/en/É", "http://com./", "http://x/\ny", "  http://a.b.com/EN/", "http://a.com/en/1",
    "http://a.com/en", "http://" + "a." * 3_000 + "com/en/" + "b/" * 20_000, "http://xcom/",
]
RULES = [
    ("com", "/", "allow"), ("a.com", "/en", "block"), ("COM", "/en/", "block"), ("b.com", "", "block"),
    ("b.a.com", "/en/", "allow"), ("com", "/en/É", "allow"), ("", "/a", "block"),
]


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_odd_urls(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_ENTRIES", broadcast)
    plain = [(h.lower(), p, v) for h, p, v in RULES]
    assert judged(spark, ODD, RULES, tmp_path) == [brute(u, plain, "allow") for u in ODD]


@pytest.mark.parametrize("most_blocks", [1 << 20, 1])
def test_many_rules(spark, tmp_path, monkeypatch, most_blocks):
    """Also with a filter so small that it passes nearly everything."""
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", most_blocks)
    draw = random.Random(4)

    def host():
        return ".".join(draw.choice("abc") for _ in range(draw.randint(1, 4)))

    def path():
        return "".join("/" + draw.choice("xy") for _ in range(draw.randint(0, 4)))

    rules = list({(host(), path()): draw.choice(["allow", "block"]) for _ in range(150)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{host()}{path()}" for _ in range(600)]
    made = judged(spark, urls, rules, tmp_path, "block")
    assert made == [brute(u, rules, "block") for u in urls]


def test_contradictions_and_nulls(spark, tmp_path):
    rules = [("a", "/", "allow"), ("a", "/", "block"), (None, "/", "block"), ("b", None, "block"), ("c", "/", None)]
    urls = ["http://a/", "http://b/", "http://c/"]
    assert judged(spark, urls, rules, tmp_path) == [
        ("a", "/", "a/", "block"), ("b", "/", None, "allow"), ("c", "/", "c/", "allow")
    ]


def test_empty_tables(spark, tmp_path):
    assert judged(spark, [], RULES, tmp_path / "a") == []
    assert judged(spark, ["http://a/b?c"], [], tmp_path / "b", "block") == [("a", "/b", None, "block")]


def test_no_python_in_the_plan(spark, tmp_path, capsys):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string").write.parquet(path)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    url_filter.judge(spark.read.parquet(path), rules, "page_id").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_the_filter_loses_nothing(spark):
    entries = [(f"h{k}.com", f"/{k % 7}/", k % 2 == 0) for k in range(5_000)]
    rules = spark.createDataFrame(entries, "rule_host string, rule_path string, blocks boolean")
    bloom = url_filter.bloom_filter(rules, 512)
    probed = rules.withColumn("block", url_filter._block(512)).join(bloom, "block")
    mask = url_filter._mask()
    assert probed.where(probed.bits.bitwiseAND(mask) == mask).count() == 5_000
    others = rules.selectExpr("concat('x', rule_host) AS rule_host", "rule_path")
    passed = others.withColumn("block", url_filter._block(512)).join(bloom, "block")
    assert passed.where(passed.bits.bitwiseAND(mask) == mask).count() < 2_500
