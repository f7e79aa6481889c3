"""The results of the catalog in SQL, written against the tables alone."""

from __future__ import annotations

from oddwire.schema import (
    ATTACK_CLASSES,
    CATEGORICAL_COLUMNS,
    CONNECTION_FEATURES,
    FEATURE_COLUMNS,
    NORMAL,
    NUMERIC_FEATURES,
    RATIOS,
    STANDARD_HEADERS,
    SYMBOLIC_CONNECTION_FEATURES,
    header_columns,
    parameter_columns,
    ratio_columns,
)
from table_queries.catalog import DETECTION_THRESHOLD, TUNE_SEED
from table_queries.derived import FILE_PAGES

STANDARD_LIST = ", ".join(f"'{name}'" for name in STANDARD_HEADERS)


def _after_scheme(url: str) -> str:
    """What follows :// without the fragment, empty for any other kind of address."""
    scheme = f"lower(split_part({url}, '://', 1)) IN ('http', 'https', 'ftp', 'file')"
    return (
        f"CASE WHEN instr({url}, '://') > 0 AND {scheme} "
        f"THEN split_part(substr({url}, instr({url}, '://') + 3), '#', 1) ELSE '' END"
    )


def url_path(url: str) -> str:
    before = f"split_part({_after_scheme(url)}, '?', 1)"
    return f"CASE WHEN instr({before}, '/') > 0 THEN substr({before}, instr({before}, '/')) ELSE '' END"


def url_query(url: str) -> str:
    rest = f"({_after_scheme(url)})"
    return f"CASE WHEN instr({rest}, '?') > 0 THEN substr({rest}, instr({rest}, '?') + 1) ELSE '' END"


def _connection_columns() -> str:
    """Every field of the records ``connection_lines`` writes, null where it cannot be read."""
    columns = []
    for name in CONNECTION_FEATURES:
        kind = "l_quantity::VARCHAR" if name in SYMBOLIC_CONNECTION_FEATURES else "l_quantity"
        bad = "reason = 'field_count'" + (" OR reason = 'number'" if name == CONNECTION_FEATURES[0] else "")
        columns.append(f"CASE WHEN {bad} THEN NULL ELSE {kind} END AS {name}")
    return ", ".join(columns)



def matches(pattern: str, value: str) -> str:
    """Number of matches of a pattern."""
    return f"len(regexp_extract_all({value}, '{pattern}'))::BIGINT"


def counts(value: str) -> dict[str, str]:
    printable, letters, digits = (
        matches("[ -~]", value), matches(r"\p{L}", value), matches(r"\p{Nd}", value)
    )
    return {
        "printable_characters": printable,
        "non_printable_characters": f"(length({value}) - {printable})",
        "letter": letters,
        "digit": digits,
        "symbol": f"({printable} - {letters} - {digits})",
    }


def two_decimals(count: str, length: str) -> str:
    """Half-up rounding in whole hundredths."""
    return (
        f"CASE WHEN coalesce({length}, 0) = 0 THEN 0.0::DOUBLE WHEN {count} < 0 "
        f"THEN 0.0::DOUBLE - ((200 * -({count}) + {length}) // (2 * {length}))::DOUBLE / 100 "
        f"ELSE ((200 * ({count}) + {length}) // (2 * {length}))::DOUBLE / 100 END"
    )


def ratios(value: str, names: list[str]) -> str:
    return ", ".join(
        f"{two_decimals(count, f'length({value})')} AS {name}"
        for name, count in zip(names, counts(value).values())
    )


def line_count(value: str) -> str:
    trimmed = f"rtrim({value}, chr(13) || chr(10))"
    return (
        f"CASE WHEN {value} = '' THEN 1 WHEN {trimmed} = '' THEN 0 "
        f"ELSE 1 + {matches(r'\r\n?|\n', trimmed)} END::BIGINT"
    )


def word_gaps(value: str) -> str:
    return (
        rf"CASE WHEN {value} = '' THEN 1 ELSE {matches(r'\W+', value)} + "
        rf"CASE WHEN regexp_matches({value}, '^\w') AND regexp_matches({value}, '\W') THEN 1 ELSE 0 END END::BIGINT"
    )


def extension(path: str) -> str:
    found = rf"regexp_extract({path}, '(\.[^./]*)$', 1)"
    return f"CASE WHEN {found} = '' THEN 'no_file_extension' ELSE {found} END"


def is_file(path: str) -> str:
    return rf"regexp_matches({path}, '\.[^./]*$')::INT"


def occurrences(value: str, char: str) -> str:
    return f"(length({value}) - length(replace({value}, '{char}', '')))"


def piece_key(piece: str) -> str:
    return f"CASE WHEN instr({piece}, '=') > 1 THEN substr({piece}, 1, instr({piece}, '=') - 1) ELSE {piece} END"


def piece_value(piece: str) -> str:
    return f"CASE WHEN instr({piece}, '=') > 1 THEN substr({piece}, instr({piece}, '=') + 1) ELSE '' END"


def parameters(source: str, keys: str, query: str) -> str:
    """Last value per key and row of a query string."""
    return f"""
        SELECT {keys}, {piece_key('piece')} AS parameter, arg_max({piece_value('piece')}, pos) AS value
        FROM (
            SELECT {keys}, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS pos
            FROM (SELECT {keys}, string_split(rtrim({query}, '&'), '&') AS pieces
                  FROM {source} WHERE rtrim({query}, '&') <> '')
        ) GROUP BY ALL"""


REQUESTS = rf"""
    parts AS (
        SELECT page_id, url, html,
            regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host,
            regexp_extract(url, '/([a-z][a-z])/', 1) AS lang,
            regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
        FROM pages),
    written AS (
        SELECT page_id, host AS file, list_concat(
            ['GET ' || url || ' HTTP/1.1', 'Host: ' || host, 'User-Agent: Mozilla/5.0 (' || lang || ')',
             'Accept: text/html,application/xml;q=0.9', 'Accept-Language: ' || lang,
             'Connection: ' || CASE WHEN url LIKE 'https%' THEN 'keep-alive' ELSE 'close' END,
             'Cookie: page=' || page_id, 'Cookie: page=' || page_id || '; lang=' || lang,
             'X-Rank: ' || page_id, '', ''],
            ['POST ' || url || ' HTTP/1.1', 'Host: ' || host,
             'Content-Type: text/html; charset=utf-8, text/plain', 'Content-Length: ' || length(html),
             'Referer: ' || url, 'Warning: ' || title, 'Connection: close', ''],
            list_filter(string_split(html, chr(10)), lambda line: line <> ''), ['']) AS lines
        FROM parts),
    lines AS (
        SELECT file, page_id, unnest(lines) AS value, unnest(range(1, len(lines) + 1)) AS pos
        FROM written),
    numbered AS (
        SELECT file, value, row_number() OVER in_file AS line_no,
            coalesce(sum((value = '')::INT) OVER (in_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS section
        FROM lines WINDOW in_file AS (PARTITION BY file ORDER BY page_id, pos)),
    sections AS (
        SELECT file, value, line_no, section // 2 AS request_no, section % 2 AS in_body FROM numbered),
    assembled AS (
        SELECT file, request_no, min(line_no) AS line_no, arg_min(value, line_no) AS request_line,
            coalesce(string_agg(value, chr(10) ORDER BY line_no) FILTER (WHERE in_body = 1 AND value <> ''), '') AS body
        FROM sections GROUP BY file, request_no),
    headers AS (
        SELECT file, request_no,
            CASE WHEN instr(s.value, ':') = 0 THEN s.value ELSE substr(s.value, 1, instr(s.value, ':') - 1) END AS header,
            arg_max(CASE WHEN instr(s.value, ':') = 0 THEN '' ELSE substr(s.value, instr(s.value, ':') + 2) END, s.line_no) AS value
        FROM sections s JOIN assembled a USING (file, request_no)
        WHERE in_body = 0 AND s.value <> '' AND s.line_no > a.line_no
        GROUP BY ALL),
    header_counts AS (
        SELECT file, request_no, count(*) AS num_headers, count(*) FILTER (WHERE header IN ({STANDARD_LIST})) AS num_standard
        FROM headers GROUP BY file, request_no),
    located AS (
        SELECT file, request_no, line_no, body, num_headers, num_standard,
            split_part(request_line, ' ', 1) AS method, split_part(request_line, ' ', 2) AS uri,
            split_part(request_line, ' ', 3) AS standard,
            {url_path("split_part(request_line, ' ', 2)")} AS path,
            {url_query("split_part(request_line, ' ', 2)")} AS query
        FROM assembled JOIN header_counts USING (file, request_no)),
    params AS ({parameters('located', 'file, request_no', 'query')}),
    param_counts AS (SELECT file, request_no, count(*) AS num_parameters FROM params GROUP BY file, request_no),
    requests AS (
        SELECT located.*, coalesce(num_parameters, 0) AS num_parameters,
            1 + coalesce(sum(1 + num_headers + CASE WHEN body = '' THEN 2 ELSE 3 END)
                OVER (PARTITION BY file ORDER BY request_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS id,
            CASE WHEN regexp_matches(file, 'spam|cheap') THEN 'anomaly' ELSE 'normal' END AS label
        FROM located LEFT JOIN param_counts USING (file, request_no))"""


def _request_features() -> str:
    blocks = ", ".join(
        f"length({part})::INT AS length_{part}, {ratios(part, ratio_columns(part))}"
        for part in ("path", "query", "body")
    )
    header_blocks = []
    for name in STANDARD_HEADERS:
        length, *ratio_names, is_standard = header_columns(name)
        header_blocks.append(f"(count(*) FILTER (WHERE header = '{name}'))::INT AS {length}")
        header_blocks += [
            f"coalesce(max(h_{ratio}) FILTER (WHERE header = '{name}'), 0.0) AS {column}"
            for ratio, column in zip(RATIOS, ratio_names)
        ]
        header_blocks.append(f"1::INT AS {is_standard}")
    return rf"""WITH {REQUESTS},
    header_ratios AS (
        SELECT file, request_no, header, value, {ratios('value', [f'h_{r}' for r in RATIOS])} FROM headers),
    header_blocks AS (
        SELECT file, request_no,
            max(CASE WHEN header = 'Connection' AND value = 'keep-alive' THEN 1 ELSE 0 END)::INT AS is_persistent_connection,
            coalesce(max(split_part(value, ',', 1)) FILTER (WHERE header = 'Content-Type'), 'no_content') AS content_type,
            {', '.join(header_blocks)}
        FROM header_ratios GROUP BY file, request_no),
    all_columns AS (
        SELECT id, method, {blocks}, {occurrences('path', '/')}::INT AS num_segment, {is_file('path')} AS is_file,
            {extension('path')} AS file_extension, num_parameters::INT AS num_parameters, num_headers::INT AS num_headers,
            {two_decimals('num_standard', 'num_headers')} AS standard_headers_ratio,
            {two_decimals('(num_headers - num_standard)', 'num_headers')} AS non_standard_headers_ratio,
            h.* EXCLUDE (file, request_no),
            ({line_count('body')})::INT AS num_line, ({word_gaps('body')})::INT AS num_word, label
        FROM requests JOIN header_blocks h USING (file, request_no))
    SELECT {', '.join(FEATURE_COLUMNS)} FROM all_columns"""


def _entry_features(name: str, part: str) -> str:
    return f"""SELECT file, request_no, id, {name}, 1::INT AS length_{part}, {ratios('value', ratio_columns(part))}"""


def _named_parameter_features(names: list[str]) -> str:
    columns = []
    for name in names:
        length, *ratio_names = parameter_columns(name)
        columns.append(f"(count(*) FILTER (WHERE parameter = '{name}'))::INT AS {length}")
        columns += [
            f"coalesce(max(p_{ratio}) FILTER (WHERE parameter = '{name}'), 0.0) AS {column}"
            for ratio, column in zip(RATIOS, ratio_names)
        ]
    return f"""WITH {REQUESTS},
    p AS (SELECT file, request_no, parameter, {ratios('value', [f'p_{r}' for r in RATIOS])} FROM params)
    SELECT r.file, r.request_no, r.id, {', '.join(columns)}
    FROM requests r LEFT JOIN p USING (file, request_no) GROUP BY ALL"""


def _statistics() -> str:
    kinds = {
        "MIME type": "Accept", "encoding": "Accept-Encoding", "charset": "Accept-Charset",
        "language": "Accept-Language", "content type": "Content-Type",
    }
    looked_up = " UNION ALL ".join(
        f"""SELECT '{kind}', coalesce(split_part(h.value, ',', 1), 'no_content') FROM requests r
        LEFT JOIN headers h ON h.file = r.file AND h.request_no = r.request_no AND h.header = '{name}'"""
        for kind, name in kinds.items()
    )
    return f"""{REQUESTS},
    observed(kind, value) AS (
        SELECT 'path', path FROM requests UNION ALL SELECT 'standard', standard FROM requests
        UNION ALL SELECT 'parameter', parameter FROM params UNION ALL SELECT 'header', header FROM headers
        UNION ALL {looked_up}),
    distinct_values AS (SELECT kind, value, count(*) AS occurrences FROM observed GROUP BY kind, value)"""


def _string_index(table: str, column: str) -> str:
    return f"""(SELECT {column}, row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS idx
        FROM {table} GROUP BY {column})"""


def _one_hot(column: str) -> str:
    """Comma-separated indicator of all indexes but the last."""
    last = f"(SELECT max(idx) FROM {column}_idx)"
    return (
        f"array_to_string(list_transform(range(0, {last}), lambda i: CASE WHEN i = {column}_idx.idx THEN 1 ELSE 0 END), ',')"
        f" AS {column}"
    )


def _prepared_vectors() -> str:
    categories = " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c} AS val, count(*) AS k FROM r GROUP BY {c}" for c in CATEGORICAL_COLUMNS
    )
    own = " UNION ALL ".join(f"SELECT rid, '{c}' AS col, {c} AS val FROM r" for c in CATEGORICAL_COLUMNS)
    numeric = ", ".join(f"{c}::DOUBLE AS {c}" for c in NUMERIC_FEATURES)
    return f"""WITH f AS ({_request_features()}),
    r AS (SELECT row_number() OVER () AS rid, * FROM f),
    long AS (UNPIVOT (SELECT rid, {numeric} FROM r) ON COLUMNS(* EXCLUDE (rid)) INTO NAME name VALUE x),
    stats AS (SELECT name, avg(x) AS m, stddev_samp(x) AS s FROM long GROUP BY name),
    numeric_part AS (
        SELECT rid, count(*) AS n, sum(CASE WHEN s > 0 THEN power((x - m) / s, 2) ELSE 0 END) AS q
        FROM long JOIN stats USING (name) GROUP BY rid),
    categories AS ({categories}),
    indexed AS (
        SELECT *, row_number() OVER (PARTITION BY col ORDER BY k DESC, val) AS pos, count(*) OVER (PARTITION BY col) AS size,
            k::DOUBLE / (SELECT count(*) FROM r) AS p, (SELECT count(*) FROM r)::DOUBLE AS total FROM categories),
    kept AS (
        SELECT col, val, p * p / var AS absent, (1 - p) * (1 - p) / var AS present
        FROM (SELECT *, p * (1 - p) * total / (total - 1) AS var FROM indexed) WHERE pos < size),
    base AS (SELECT count(*) AS n, sum(absent) AS q FROM kept),
    own AS (SELECT rid, sum(present - absent) AS q FROM ({own}) JOIN kept USING (col, val) GROUP BY rid)
    SELECT id, label, (numeric_part.n + base.n)::BIGINT AS num_features,
        round(numeric_part.q + base.q + coalesce(own.q, 0), 4) AS squared_norm
    FROM r JOIN numeric_part USING (rid) CROSS JOIN base LEFT JOIN own USING (rid)"""


def _prepare_train_test() -> str:
    numeric = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    counts = " UNION ALL ".join(
        f"SELECT {i} AS col, {c} AS val, count(*) AS k, count(*) FILTER (WHERE file_extension IS NOT NULL) AS known"
        f" FROM train WHERE {c} IS NOT NULL GROUP BY {c}"
        for i, c in enumerate(CATEGORICAL_COLUMNS)
    )
    found = " UNION ALL ".join(
        f"SELECT {i} AS col, {c} AS val, count(*) AS k FROM kept GROUP BY {c}"
        for i, c in enumerate(CATEGORICAL_COLUMNS)
    )
    same = " AND ".join(f"{c} IN (SELECT {c} FROM train)" for c in CATEGORICAL_COLUMNS)
    elements = " UNION ALL ".join(
        f"SELECT {i} AS element, avg({c}) / (SELECT stddev_samp({c}) FROM known) AS mean, "
        f"count(*) FILTER (WHERE {c} <> 0) AS used FROM kept"
        for i, c in enumerate(numeric)
    )
    return f"""WITH t AS (
        SELECT l_returnflag AS method, CASE WHEN l_linenumber <> 2 THEN 'line ' || l_linenumber END AS file_extension,
            l_linestatus AS content_type, {", ".join(numeric)} FROM lineitem),
    train AS (SELECT * FROM t WHERE method <> 'R'),
    known AS (SELECT * FROM train WHERE file_extension IS NOT NULL),
    kept AS (SELECT * FROM t WHERE {same}),
    counts AS ({counts}),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY col ORDER BY k DESC, val) AS pos,
            count(*) OVER (PARTITION BY col) AS size, known::DOUBLE / (SELECT count(*) FROM known) AS p FROM counts),
    placed AS (SELECT *, row_number() OVER (ORDER BY col, pos) AS place FROM ranked WHERE pos < size),
    total AS (SELECT (SELECT count(*) FROM kept) AS n_rows, (SELECT count(*) FROM known)::DOUBLE AS n),
    found AS ({found}),
    elements AS (
        {elements}
        UNION ALL SELECT {len(numeric) - 1} + place, coalesce(f.k, 0) / n_rows / sqrt(p * (1 - p) * n / (n - 1)), coalesce(f.k, 0)
        FROM placed LEFT JOIN found f USING (col, val) CROSS JOIN total)
    SELECT element::BIGINT AS element, n_rows, round(mean, 6) AS mean, used::BIGINT AS used FROM elements CROSS JOIN total"""


def _tune() -> str:
    """Silhouettes on the rows that the split holds back, for both meanings of a cluster."""

    def silhouette(cluster: str) -> str:
        return f"""(WITH c AS (SELECT *, {cluster} AS cl FROM held),
            sizes AS (SELECT cl, count(DISTINCT vec_id)::DOUBLE AS n FROM c GROUP BY cl),
            sums AS (SELECT cl, i, sum(x) AS y FROM c GROUP BY cl, i),
            norms AS (SELECT vec_id, cl, sum(x * x) AS xi FROM c GROUP BY vec_id, cl),
            psi AS (SELECT cl, sum(xi) AS psi FROM norms GROUP BY cl),
            dots AS (SELECT c.vec_id, s.cl AS other, sum(x * y) AS d FROM c JOIN sums s USING (i) GROUP BY c.vec_id, s.cl),
            means AS (
                SELECT m.vec_id, m.cl, other, sz.n, m.xi + psi.psi / sz.n - 2 * d / sz.n AS mean
                FROM norms m JOIN dots USING (vec_id) JOIN sizes sz ON sz.cl = other JOIN psi ON psi.cl = other),
            ab AS (
                SELECT vec_id, max(n) FILTER (WHERE other = cl) AS n,
                    max(mean * n / nullif(n - 1, 0)) FILTER (WHERE other = cl) AS a,
                    min(mean) FILTER (WHERE other <> cl) AS b FROM means GROUP BY vec_id, cl)
            SELECT avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) FROM ab)"""

    return f"""WITH rows AS (
        SELECT vec_id, label, list_concat(embedding::DOUBLE[],
            list_transform(range(0, 11), lambda i: CASE WHEN i = label THEN 300.0::DOUBLE
                WHEN i = 10 AND label >= 5 THEN 10000.0::DOUBLE ELSE 0.0::DOUBLE END)) AS v FROM embeddings
        WHERE ('0x' || substr(md5('{TUNE_SEED}:' || vec_id), 1, 8))::BIGINT >= 0.8 * 4294967296),
    held AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM rows),
    metrics AS (SELECT {silhouette('label >= 5')} AS s2, {silhouette('label')} AS s10),
    grid AS (
        SELECT unnest([0, 1, 2, 3])::INT AS grid_idx, unnest([2, 2, 10, 10])::INT AS k, unnest([5, 20, 5, 20])::INT AS "maxIter",
            0.0001::DOUBLE AS tol, unnest([s2, s2, s10, s10]) AS silhouette FROM metrics)
    SELECT grid_idx, k, "maxIter", tol, round(silhouette, 10) AS silhouette,
        round(avg(silhouette) OVER (ORDER BY grid_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 10) AS avg FROM grid"""


DISTANCES = """
    points AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
    centres AS (SELECT label, i, avg(x) AS c FROM points GROUP BY label, i),
    distances AS (
        SELECT vec_id, label, sum((x - c) * (x - c)) AS distance FROM points JOIN centres USING (label, i) GROUP BY vec_id, label)"""


def _sweep(last: int, per_unit: int) -> str:
    return f"""WITH {DISTANCES},
    steps AS (SELECT i / {per_unit}.0::DOUBLE AS threshold FROM range(0, {last * per_unit + 1}) t(i)),
    totals AS (
        SELECT threshold, count(distance) AS detected, count(distance) FILTER (WHERE label = 0) AS actual
        FROM steps LEFT JOIN distances ON distance >= threshold GROUP BY threshold)
    SELECT threshold, detected, actual,
        CASE WHEN detected > 0 THEN round(abs(actual - detected)::DOUBLE / detected * 100, 6) END AS error_rate FROM totals"""


SCORES = """
    scores AS (SELECT floor(n_chars / 1000.0)::DOUBLE AS score, quality FROM documents JOIN labels USING (doc_id)),
    steps AS (SELECT DISTINCT score AS threshold FROM scores),
    confusion AS (
        SELECT threshold, count(*) FILTER (WHERE quality = 1) AS tp, count(*) FILTER (WHERE quality = 0) AS fp,
            (SELECT count(*) FROM scores WHERE quality = 1) AS p, (SELECT count(*) FROM scores WHERE quality = 0) AS n
        FROM steps JOIN scores ON score >= threshold GROUP BY threshold),
    pr AS (SELECT threshold, tp::DOUBLE / (tp + fp) AS precision, CASE WHEN p = 0 THEN 0 ELSE tp::DOUBLE / p END AS recall FROM confusion),
    fm AS (
        SELECT beta, threshold, CASE WHEN precision + recall = 0 THEN 0
            ELSE (1 + beta * beta) * precision * recall / (beta * beta * precision + recall) END AS f
        FROM pr CROSS JOIN (VALUES (0.5::DOUBLE), (1.0), (2.0), (3.0)) b(beta))"""
ROC = """
    roc AS (
        SELECT 0 AS point, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y UNION ALL
        SELECT row_number() OVER (ORDER BY threshold DESC)::INT, CASE WHEN n = 0 THEN 0 ELSE fp::DOUBLE / n END,
            CASE WHEN p = 0 THEN 0 ELSE tp::DOUBLE / p END FROM confusion UNION ALL
        SELECT (SELECT count(*) FROM confusion)::INT + 1, 1.0, 1.0)"""
PR = """
    pr_points AS (
        SELECT row_number() OVER (ORDER BY threshold DESC)::INT AS point, recall AS x, precision AS y FROM pr),
    pr_curve AS (SELECT * FROM pr_points UNION ALL SELECT 0, 0.0, y FROM pr_points WHERE point = 1)"""


def _area(curve: str) -> str:
    return f"""SELECT coalesce(sum(a), 0) FROM (
        SELECT (x - lag(x) OVER (ORDER BY point)) * (y + lag(y) OVER (ORDER BY point)) / 2 AS a FROM {curve})"""


GRID = """
    means AS (
        SELECT l_discount AS tol, l_linenumber AS k, l_quantity::INT AS "maxIter", avg(l_extendedprice) / 99991 AS silhouette
        FROM lineitem GROUP BY ALL),
    grid AS (
        SELECT (row_number() OVER (ORDER BY tol, k, "maxIter") - 1)::INT AS grid_idx, * FROM means),
    results AS (
        SELECT *, avg(silhouette) OVER (ORDER BY grid_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS avg FROM grid)"""

TUNING_COLUMNS = 'grid_idx, k, "maxIter", tol, round(silhouette, 6) AS silhouette, round(avg, 6) AS avg'

EVENTS = r"""
    e AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, regexp_extract(props, '(\d+)', 1) AS port,
        (value >= 30)::INT AS serr, (value < 3)::INT AS rerr FROM events)"""


def _recent(seconds: int) -> str:
    frame = f"ORDER BY us RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND CURRENT ROW"
    return f"""WITH {EVENTS},
    w AS (
        SELECT event_id, count(*) OVER h AS c, sum(serr) OVER h AS hs, sum(rerr) OVER h AS hr, count(*) OVER b AS hb,
            count(*) OVER s AS sc, sum(serr) OVER s AS ss, sum(rerr) OVER s AS sr
        FROM e WINDOW h AS (PARTITION BY user_id {frame}), s AS (PARTITION BY event_type {frame}),
            b AS (PARTITION BY user_id, event_type {frame}))
    SELECT event_id, c AS count, sc AS srv_count,
        round(hs::DOUBLE / c, 8) AS serror_rate, round(hr::DOUBLE / c, 8) AS rerror_rate,
        round(hb::DOUBLE / c, 8) AS same_srv_rate, round((c - hb)::DOUBLE / c, 8) AS diff_srv_rate,
        round(ss::DOUBLE / sc, 8) AS srv_serror_rate, round(sr::DOUBLE / sc, 8) AS srv_rerror_rate,
        round((sc - hb)::DOUBLE / sc, 8) AS srv_diff_host_rate FROM w"""


# The last 100 rows of a host as lists, filtered by the service of the current row.
LAST_100 = f"""WITH {EVENTS},
    w AS (
        SELECT *, list(struct_pack(t := event_type, p := port, s := serr, r := rerr)) OVER h AS hl,
            list(user_id) OVER s AS sl
        FROM e WINDOW h AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW),
            s AS (PARTITION BY event_type ORDER BY us, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
    c AS (
        SELECT *, len(hl) AS n, list_filter(hl, lambda x: x.t = event_type) AS same FROM w)
    SELECT event_id, n::BIGINT AS dst_host_count, len(same)::BIGINT AS dst_host_srv_count,
        round(len(same)::DOUBLE / n, 8) AS dst_host_same_srv_rate,
        round((n - len(same))::DOUBLE / n, 8) AS dst_host_diff_srv_rate,
        round(len(list_filter(hl, lambda x: x.p = port))::DOUBLE / n, 8) AS dst_host_same_src_port_rate,
        round(len(list_filter(sl, lambda u: u <> user_id))::DOUBLE / len(sl), 8) AS dst_host_srv_diff_host_rate,
        round(list_sum(list_transform(hl, lambda x: x.s))::DOUBLE / n, 8) AS dst_host_serror_rate,
        round(list_sum(list_transform(same, lambda x: x.s))::DOUBLE / len(same), 8) AS dst_host_srv_serror_rate,
        round(list_sum(list_transform(hl, lambda x: x.r))::DOUBLE / n, 8) AS dst_host_rerror_rate,
        round(list_sum(list_transform(same, lambda x: x.r))::DOUBLE / len(same), 8) AS dst_host_srv_rerror_rate
    FROM c"""

HEADS = r"""
    heads AS (
        SELECT 'documents' AS file, doc_id AS request_no,
            list_filter(string_split(text, chr(10)), lambda line: line <> '') AS head FROM documents
        UNION ALL
        SELECT 'conversation ' || conv_id, turn, list_concat(
            [role || ' http://h/?turn=' || turn || CASE WHEN role = 'system' THEN '&&x' ELSE '' END || ' HTTP/1.1'],
            list_filter(string_split(text, chr(10)), lambda line: line <> '')) FROM conversations),
    split AS (SELECT file, request_no, coalesce(head[1], '') AS line, head[2:] AS header_lines FROM heads)"""

ATTACK_VALUES = ", ".join(f"('{name}', '{kind}')" for name, kind in [*ATTACK_CLASSES.items(), (NORMAL, NORMAL)])
ATTACK_LIST = ", ".join(f"'{name}'" for name in [*ATTACK_CLASSES, NORMAL])

AS_QUERY = r"'k=' || regexp_replace(regexp_replace(text, '[ \n]+', '&', 'g'), '[.,]&', '=&', 'g')"


def oracles() -> dict[str, str]:
    text_counts = counts("text")
    value_ratio = {
        "printable_ratio": "printable_characters", "non_printable_ratio": "non_printable_characters",
        "letter_ratio": "letter", "digit_ratio": "digit", "symbol_ratio": "symbol",
    }
    joined = counts("v")
    file_requests = REQUESTS.replace("host AS file", f"host || '-' || (page_id // {FILE_PAGES}) AS file")
    return {
        "char_class_counts": f"""SELECT doc_id, length(text)::BIGINT AS n_length,
            {text_counts['printable_characters']} AS n_printable,
            {text_counts['non_printable_characters']} AS n_non_printable, {text_counts['letter']} AS n_letter,
            {text_counts['digit']} AS n_digit, {text_counts['symbol']} AS n_symbol FROM documents""",
        "char_class_ratios": f"""SELECT doc_id, length(text)::INT AS length_text,
            {ratios('text', ratio_columns('text'))} FROM documents""",
        "value_list_ratios": "SELECT conv_id, turn, " + ", ".join(
            f"CASE WHEN v = '' THEN 0 ELSE round({joined[kind]}::DOUBLE / length(v), 8) END AS {name}"
            for name, kind in value_ratio.items()
        ) + " FROM (SELECT conv_id, turn, role || text AS v FROM conversations)",
        "line_word_counts": " UNION ALL ".join(
            f"SELECT '{source}' AS source_table, {key} AS id, {line_count(value)} AS num_line, {word_gaps(value)} AS num_word FROM {source}"
            for source, key, value in (
                ("documents", "doc_id", "text"),
                ("conversations", "conv_id * 1000 + turn", "text"),
                ("pages", "page_id", "html"),
            )
        ),
        "url_features": f"""WITH u AS (
            SELECT page_id, {url_path('url')} AS path, {url_query('url')} AS query FROM pages),
            p AS (SELECT page_id, count(*)::INT AS n FROM ({parameters('u', 'page_id', 'query')}) GROUP BY page_id)
            SELECT page_id, path, query, {occurrences('path', '/')}::INT AS num_segment, {is_file('path')} AS is_file,
                {extension('path')} AS file_extension, coalesce(n, 0)::INT AS num_parameters,
                length(path)::INT AS length_path, {ratios('path', ratio_columns('path'))},
                length(query)::INT AS length_query, {ratios('query', ratio_columns('query'))}
            FROM u LEFT JOIN p USING (page_id)""",
        "query_parameters": f"""WITH u AS (SELECT page_id, {url_query('url')} AS query FROM pages)
            {parameters('u', 'page_id', 'query')}""",
        "text_parameters": f"""WITH u AS (SELECT conv_id, turn, {AS_QUERY} AS query FROM conversations)
            {parameters('u', 'conv_id, turn', 'query')}""",
        "parameter_features": f"""WITH {REQUESTS} {_entry_features('parameter', 'parameter')}
            FROM params JOIN requests USING (file, request_no)""",
        "named_parameter_features": _named_parameter_features(["page", "utm_source"]),
        "request_assembly": f"""WITH {REQUESTS} SELECT file, request_no, line_no, id, method, uri, standard, path, query,
            num_parameters, num_headers, body, label FROM requests""",
        "request_files": f"""WITH {file_requests}
            SELECT file, request_no, line_no, id, method, uri, standard, path, query,
            num_parameters, num_headers, body, label FROM requests""",
        "request_headers": f"WITH {REQUESTS} SELECT file, request_no, header, value FROM headers",
        "header_lookup": f"""WITH {REQUESTS} SELECT file, request_no,
            coalesce(max(split_part(value, ',', 1)) FILTER (WHERE header = 'Accept'), 'no_content') AS accept,
            coalesce(max(split_part(value, ',', 1)) FILTER (WHERE header = 'Content-Type'), 'no_content') AS content_type,
            coalesce(max(split_part(value, ',', 1)) FILTER (WHERE header = 'Cookie'), 'no_content') AS cookie,
            max((header = 'Connection' AND value = 'keep-alive')::INT) AS is_persistent_connection,
            (count(*) FILTER (WHERE header IN ({STANDARD_LIST})))::INT AS num_standard
            FROM headers GROUP BY file, request_no""",
        "header_features": f"""WITH {REQUESTS} {_entry_features('header', 'header')},
            (header IN ({STANDARD_LIST}))::INT AS is_standard_header
            FROM headers JOIN requests USING (file, request_no)""",
        "malformed_requests": f"""WITH {HEADS} SELECT file, request_no,
            CASE WHEN {occurrences('line', ' ')} <> 2 OR length(line) = 2 THEN 'request_line'
                WHEN len(list_filter(header_lines, lambda h: instr(h, ':') = 1)) > 0 THEN 'header_key'
                WHEN len(list_filter(header_lines, lambda h: instr(h, ':') > 0 AND instr(h, ':') = length(h))) > 0 THEN 'header_value'
                WHEN regexp_matches(rtrim({url_query("split_part(line, ' ', 2)")}, '&'), '^&|&&') THEN 'parameter_key'
                ELSE 'none' END AS reason FROM split""",
        "request_features": _request_features(),
        "feature_files": _request_features(),
        "labelled_union": """SELECT doc_id AS id, 'normal' AS label, text FROM documents
            UNION ALL SELECT item_id, 'anomaly', text FROM benchmark""",
        "request_count": "SELECT 2 * count(*)::BIGINT AS num_requests FROM pages",
        "distinct_values": f"WITH {_statistics()} SELECT kind, value, occurrences FROM distinct_values",
        "distinct_counts": f"WITH {_statistics()} SELECT kind, count(*) AS num_unique FROM distinct_values GROUP BY kind",
        "sorted_values": f"WITH {_statistics()} SELECT kind, value FROM distinct_values ORDER BY kind, value",
        "string_index": f"""SELECT doc_id, lang, source, l.idx::DOUBLE AS lang_index, s.idx::DOUBLE AS source_index
            FROM documents JOIN {_string_index('documents', 'lang')} l USING (lang)
            JOIN {_string_index('documents', 'source')} s USING (source)""",
        "one_hot": f"""WITH l_returnflag_idx AS {_string_index('lineitem', 'l_returnflag')},
            l_linestatus_idx AS {_string_index('lineitem', 'l_linestatus')}
            SELECT l_orderkey, l_linenumber, {_one_hot('l_returnflag')}, {_one_hot('l_linestatus')}
            FROM lineitem JOIN l_returnflag_idx USING (l_returnflag) JOIN l_linestatus_idx USING (l_linestatus)""",
        "standard_scale": "SELECT l_orderkey, l_linenumber, " + ", ".join(
            f"round((l_{c} - avg(l_{c}) OVER ()) / stddev_samp(l_{c}) OVER (), 4) + 0.0 AS scaled_{c}"
            for c in ("quantity", "extendedprice", "discount", "tax")
        ) + " FROM lineitem",
        "prepared_vectors": _prepared_vectors(),
        "prepare_train_test": _prepare_train_test(),
        "kmeans_fit": f"""WITH {DISTANCES} SELECT vec_id AS id, label, min(vec_id) OVER (PARTITION BY label) AS prediction,
            round(distance, 6) AS distance FROM distances""",
        "tune": _tune(),
        "centroid_distance": f"WITH {DISTANCES} SELECT vec_id, label, round(distance, 6) AS distance FROM distances",
        "nearest_centroid": f"""WITH {DISTANCES},
            pairs AS (
                SELECT vec_id, c.label AS cluster, sum((x - c) * (x - c)) AS distance
                FROM points p JOIN centres c USING (i) GROUP BY vec_id, c.label)
            SELECT vec_id, arg_min(cluster, distance) AS prediction, round(min(distance), 6) AS distance FROM pairs GROUP BY vec_id""",
        "detect_anomalies": f"""WITH {DISTANCES} SELECT vec_id, label, round(distance, 6) AS distance
            FROM distances WHERE distance >= {DETECTION_THRESHOLD}""",
        "threshold_sweep": _sweep(10, 10),
        "sweep_files": f"SELECT * REPLACE (round(error_rate, 2) AS error_rate) FROM ({_sweep(10, 10)})",
        "fine_threshold_sweep": _sweep(2, 50),
        "anomaly_counts": f"""WITH {DISTANCES}, t AS (
            SELECT count(*) FILTER (WHERE label = 0) AS total_anomalies,
                count(*) FILTER (WHERE distance >= {DETECTION_THRESHOLD}) AS detected,
                count(*) FILTER (WHERE distance >= {DETECTION_THRESHOLD} AND label = 0) AS actual FROM distances)
            SELECT *, CASE WHEN detected > 0 THEN round(abs(actual - detected)::DOUBLE / detected * 100, 6) END AS error_rate FROM t""",
        "precision_recall": f"""WITH {SCORES} SELECT threshold, round(precision, 8) AS precision,
            round(recall, 8) AS recall FROM pr""",
        "evaluation_files": f"""WITH {SCORES} SELECT threshold, round(precision, 8) AS precision,
            round(recall, 8) AS recall FROM pr""",
        "f_beta": f"WITH {SCORES} SELECT beta, threshold, round(f, 8) AS f FROM fm",
        "best_f_beta": f"""WITH {SCORES} SELECT beta, threshold, round(f, 8) AS f FROM fm
            QUALIFY row_number() OVER (PARTITION BY beta ORDER BY f DESC, threshold DESC) = 1""",
        "f_beta_pivot": f"""WITH {SCORES} SELECT beta, string_agg(
            threshold::VARCHAR || ':' || printf('%.10f', f), ' ' ORDER BY threshold DESC) AS f_by_threshold
            FROM fm GROUP BY beta""",
        "roc_curve": f"WITH {SCORES}, {ROC} SELECT point, round(x, 8) AS x, round(y, 8) AS y FROM roc",
        "pr_curve": f"WITH {SCORES}, {PR} SELECT point, round(x, 8) AS x, round(y, 8) AS y FROM pr_curve",
        "areas_under_curves": f"""WITH {SCORES}, {ROC}, {PR}
            SELECT round(({_area('roc')}), 8) AS area, 'roc' AS curve
            UNION ALL SELECT round(({_area('pr_curve')}), 8), 'pr'""",
        "distance_curves": f"""WITH {DISTANCES},
            s AS (SELECT distance AS d, (count(*) FILTER (WHERE label = 0))::DOUBLE AS pos,
                    (count(*) FILTER (WHERE label <> 0))::DOUBLE AS neg FROM distances GROUP BY d),
            c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
                FROM s WINDOW w AS (ORDER BY d DESC)),
            r AS (SELECT *, tp / p AS y, fp / n AS x, tp / (tp + fp) AS pr, (tp - pos) / p AS y0, (fp - neg) / n AS x0,
                CASE WHEN tp + fp = pos + neg THEN tp / (tp + fp) ELSE (tp - pos) / (tp + fp - pos - neg) END AS pr0 FROM c)
            SELECT 'roc' AS curve, round(sum((x - x0) * (y + y0) / 2), 7) AS area FROM r
            UNION ALL SELECT 'pr', round(sum((y - y0) * (pr + pr0) / 2), 7) FROM r""",
        "silhouette": """WITH points AS (
                SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
            sizes AS (SELECT label, count(*)::DOUBLE AS n FROM embeddings GROUP BY label),
            sums AS (SELECT label, i, sum(x) AS y FROM points GROUP BY label, i),
            norms AS (SELECT vec_id, label, sum(x * x) AS xi FROM points GROUP BY vec_id, label),
            psi AS (SELECT label, sum(xi) AS psi FROM norms GROUP BY label),
            dots AS (SELECT p.vec_id, s.label AS other, sum(x * y) AS d FROM points p JOIN sums s USING (i) GROUP BY p.vec_id, s.label),
            means AS (
                SELECT m.vec_id, m.label, other, sz.n, m.xi + psi.psi / sz.n - 2 * d / sz.n AS mean
                FROM norms m JOIN dots USING (vec_id) JOIN sizes sz ON sz.label = other JOIN psi ON psi.label = other),
            ab AS (
                SELECT vec_id, max(n) FILTER (WHERE other = label) AS n,
                    max(mean * n / nullif(n - 1, 0)) FILTER (WHERE other = label) AS a,
                    min(mean) FILTER (WHERE other <> label) AS b FROM means GROUP BY vec_id, label)
            SELECT round(avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette FROM ab""",
        "tuning_report": f"WITH {GRID} SELECT {TUNING_COLUMNS} FROM results",
        "tuning_best": f"""WITH {GRID}
            SELECT {TUNING_COLUMNS}, 'avg' AS by_metric FROM (SELECT * FROM results ORDER BY results.avg DESC, grid_idx LIMIT 1)
            UNION ALL
            SELECT {TUNING_COLUMNS}, 'silhouette' FROM (SELECT * FROM results ORDER BY results.silhouette DESC, grid_idx LIMIT 1)""",
        "tuning_pivot": f"""WITH {GRID}, best AS (SELECT tol FROM results ORDER BY results.avg DESC, grid_idx LIMIT 1)
            SELECT "maxIter", {', '.join(f'round(max(avg) FILTER (WHERE k = {k}), 6) AS k_{k}' for k in range(1, 8))}
            FROM results JOIN best USING (tol) GROUP BY "maxIter" """,
        "tuning_files": f"""WITH {GRID}, best AS (SELECT tol FROM results ORDER BY results.avg DESC, grid_idx LIMIT 1)
            SELECT "maxIter", k, round(avg, 6) AS avg FROM results JOIN best USING (tol)""",
        "traffic_2s": _recent(2),
        "traffic_6h": _recent(6 * 3600),
        "traffic_last100": LAST_100,
        "connection_quarantine": f"""WITH c AS (
            SELECT l_quantity, l_suppkey, CASE WHEN l_linenumber = 7 THEN 'field_count'
                WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'number' ELSE 'none' END AS reason FROM lineitem)
            SELECT {_connection_columns()},
                CASE WHEN reason <> 'field_count' THEN [{ATTACK_LIST}][l_suppkey % 23 + 1] || '.' END AS label,
                reason FROM c""",
        "attack_classes": f"""SELECT name || '.' AS label, class AS attack_class, count(*) AS n
            FROM lineitem JOIN (VALUES {ATTACK_VALUES}) a(name, class) ON name = [{ATTACK_LIST}][l_suppkey % 23 + 1]
            WHERE l_linenumber <> 7 AND NOT (l_returnflag = 'R' AND l_linestatus = 'F') GROUP BY ALL""",
    }
