"""Fixed names and table schemas."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The standard request headers, in feature-column order.
STANDARD_HEADERS = [
    "Accept", "Accept-Charset", "Accept-Datetime", "Accept-Encoding", "Accept-Language",
    "Access-Control-Request-Method", "Access-Control-Request-Headers", "Authorization",
    "Cache-Control", "Connection", "Content-Length", "Content-MD5", "Content-Type", "Cookie",
    "Date", "Expect", "From", "Host", "If-Match", "If-Modified-Since", "If-None-Match",
    "If-Range", "If-Unmodified-Since", "Max-Forwards", "Origin", "Pragma",
    "Proxy-Authorization", "Range", "Referer", "TE", "User-Agent", "Upgrade", "Via", "Warning",
]

# Markers used in place of an absent header and an absent extension.
NO_CONTENT = "no_content"
NO_FILE_EXTENSION = "no_file_extension"

# Labels of the two kinds of traffic.
NORMAL = "normal"
ANOMALY = "anomaly"

CATEGORICAL_COLUMNS = ["method", "file_extension", "content_type"]

RATIOS = ["printable_characters", "non_printable_characters", "letter", "digit", "symbol"]


def column_suffix(key: str) -> str:
    """The key as part of a column name: non-word characters become underscores."""
    return re.sub(r"\W", "_", key, flags=re.ASCII).lower()


def ratio_columns(part: str) -> list[str]:
    return [f"{ratio}_ratio_{part}" for ratio in RATIOS]


def header_columns(header: str) -> list[str]:
    part = f"header_{column_suffix(header)}"
    return [f"length_{part}", *ratio_columns(part), f"is_standard_{part}"]


def parameter_columns(parameter: str) -> list[str]:
    part = f"parameter_{column_suffix(parameter)}"
    return [f"length_{part}", *ratio_columns(part)]


def _feature_fields() -> list[T.StructField]:
    fields: list[T.StructField] = []

    def add(kind: T.DataType, *names: str) -> None:
        fields.extend(T.StructField(name, kind, True) for name in names)

    add(T.LongType(), "id")
    add(T.StringType(), "method")
    add(T.IntegerType(), "length_path")
    add(T.DoubleType(), *ratio_columns("path"))
    add(T.IntegerType(), "num_segment", "is_file")
    add(T.StringType(), "file_extension")
    add(T.IntegerType(), "num_parameters", "length_query")
    add(T.DoubleType(), *ratio_columns("query"))
    add(T.IntegerType(), "num_headers")
    add(T.DoubleType(), "standard_headers_ratio", "non_standard_headers_ratio")
    for header in STANDARD_HEADERS:
        length, *ratios, standard = header_columns(header)
        add(T.IntegerType(), length)
        add(T.DoubleType(), *ratios)
        add(T.IntegerType(), standard)
    add(T.IntegerType(), "is_persistent_connection")
    add(T.StringType(), "content_type")
    add(T.IntegerType(), "length_body")
    add(T.DoubleType(), *ratio_columns("body"))
    add(T.IntegerType(), "num_line", "num_word")
    add(T.StringType(), "label")
    return fields


FEATURES = T.StructType(_feature_fields())

FEATURE_COLUMNS = FEATURES.fieldNames()

NUMERIC_FEATURES = [
    name for name in FEATURE_COLUMNS if name not in ("id", "label", *CATEGORICAL_COLUMNS)
]

LINES = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("split", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("value", T.StringType()),
])

REQUESTS = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("split", T.LongType()),
    T.StructField("request_no", T.LongType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("method", T.StringType()),
    T.StructField("uri", T.StringType()),
    T.StructField("standard", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("body", T.StringType()),
    T.StructField("label", T.StringType()),
])

# The 41 features of a connection record, in file order.
CONNECTION_FEATURES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised",
    "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count",
    "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
]
SYMBOLIC_CONNECTION_FEATURES = [
    "protocol_type", "service", "flag", "land", "logged_in", "is_host_login", "is_guest_login",
]

CONNECTIONS = T.StructType([
    T.StructField(
        name,
        T.StringType() if name in SYMBOLIC_CONNECTION_FEATURES else T.DoubleType(),
    )
    for name in CONNECTION_FEATURES
] + [T.StructField("label", T.StringType())])

# Class of each named attack.
ATTACK_CLASSES = {
    "back": "dos",
    "buffer_overflow": "u2r",
    "ftp_write": "r2l",
    "guess_passwd": "r2l",
    "imap": "r2l",
    "ipsweep": "probe",
    "land": "dos",
    "loadmodule": "u2r",
    "multihop": "r2l",
    "neptune": "dos",
    "nmap": "probe",
    "perl": "u2r",
    "phf": "r2l",
    "pod": "dos",
    "portsweep": "probe",
    "rootkit": "u2r",
    "satan": "probe",
    "smurf": "dos",
    "spy": "r2l",
    "teardrop": "dos",
    "warezclient": "r2l",
    "warezmaster": "r2l",
}
