"""Parts of a request as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddwire.schema import NO_CONTENT, NO_FILE_EXTENSION, STANDARD_HEADERS

# Fixed value: an absolute URL, group 1 its path and group 2 its query; the fragment is
# dropped. parse_url is of no use here, it refuses the malformed queries of attacks.
URL_PATTERN = (
    r"(?i)^(?:https?|ftp|file)://(?:[^/?#@]*@)?(?:\[[^\]/?#]*\]|[^/?#:@]*)(?::[0-9]*)?"
    r"(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
)
_EXTENSION = r"(\.[^./]*)$"


def char_occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def has_two_spaces(request_line: Column) -> Column:
    """A request line has exactly two spaces, and something besides them."""
    return (char_occurrences(request_line, " ") == 2) & (F.length(request_line) > 2)


def method(request_line: Column) -> Column:
    return F.get(F.split(request_line, " "), F.lit(0))


def uri(request_line: Column) -> Column:
    return F.coalesce(F.get(F.split(request_line, " "), F.lit(1)), F.lit(""))


def standard(request_line: Column) -> Column:
    """The protocol version: the last part that is not empty."""
    return F.substring_index(F.rtrim(request_line), " ", -1)


def url_path(address: Column) -> Column:
    """Path of an absolute URL, empty for anything else."""
    return F.coalesce(F.regexp_extract(address, URL_PATTERN, 1), F.lit(""))


def url_query(address: Column) -> Column:
    return F.coalesce(F.regexp_extract(address, URL_PATTERN, 2), F.lit(""))


def segment_count(path: Column) -> Column:
    return char_occurrences(path, "/")


def file_extension(path: Column) -> Column:
    """Extension with its dot, taken from the last path segment."""
    found = F.regexp_extract(path, _EXTENSION, 1)
    return F.when(found == "", NO_FILE_EXTENSION).otherwise(found)


def is_file(path: Column) -> Column:
    return path.rlike(_EXTENSION).cast("int")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and let ``use`` refer to it as often as it likes."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def last_wins_map(entries: Column) -> Column:
    """Map from an array of (key, value) in which the last entry of a key counts.

    Independent of the session's policy for duplicate keys. Only rows that do repeat a key
    pay for the sort, so a query with ten thousand parameters stays n log n.
    """

    def keep_last(items: Column) -> Column:
        numbered = F.transform(
            items, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value"))
        )
        lasts = _bind(
            F.sort_array(numbered),
            lambda ordered: F.filter(
                ordered,
                lambda e, i: ~F.get(ordered, i + 1)["key"].eqNullSafe(e["key"]),
            ),
        )
        return F.transform(
            lasts, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))
        )

    def build(items: Column) -> Column:
        repeats = F.size(F.array_distinct(items["key"])) < F.size(items)
        return F.map_from_entries(F.when(repeats, keep_last(items)).otherwise(items))

    return _bind(entries, build)


def parameter_entries(query: Column) -> Column:
    """Array of (key, value) of a query string, in order, repeats included.

    A piece is cut at its first ``=`` unless that is its first character; without a cut the
    whole piece is the key. Empty pieces are no parameters: those at the end are harmless,
    ``has_empty_parameter`` finds the others.
    """
    pieces = F.filter(F.split(query, "&"), lambda piece: piece != "")

    def entry(piece: Column) -> Column:
        key = F.when(piece.startswith("="), piece).otherwise(F.substring_index(piece, "=", 1))
        value = F.substring(piece, F.length(key) + 2, F.length(piece))
        return F.struct(key.alias("key"), value.alias("value"))

    return F.transform(pieces, entry)


def has_empty_parameter(query: Column) -> Column:
    """A separator with nothing before it, as in ``a&&b`` or ``&a``."""
    pieces = F.rtrim(query, F.lit("&"))
    return pieces.startswith("&") | pieces.contains("&&")


def parse_parameters(query: Column) -> Column:
    return last_wins_map(parameter_entries(query))


def header_entries(lines: Column) -> Column:
    """Array of (key, value) of header lines.

    The value begins two characters after the colon, whatever the first of them is. A line
    without colon is a key with an empty value.
    """

    def entry(line: Column) -> Column:
        key = F.substring_index(line, ":", 1)
        value = F.substring(line, F.length(key) + 3, F.length(line))
        return F.struct(key.alias("key"), value.alias("value"))

    return F.transform(lines, entry)


def header_without_value(line: Column) -> Column:
    """The line ends right at its first colon, so no value can begin."""
    cut = F.instr(line, ":")
    return (cut > 0) & (cut == F.length(line))


def header_without_key(line: Column) -> Column:
    return F.instr(line, ":") == 1


def parse_headers(lines: Column) -> Column:
    return last_wins_map(header_entries(lines))


def header_or_default(headers: Column, name: str) -> Column:
    """Value of a header up to its first comma, ``no_content`` without such a header."""
    return F.coalesce(
        F.substring_index(F.try_element_at(headers, F.lit(name)), ",", 1), F.lit(NO_CONTENT)
    )


def is_standard_header(key: Column) -> Column:
    return key.isin(STANDARD_HEADERS).cast("int")


def standard_header_count(headers: Column) -> Column:
    return F.size(F.filter(F.map_keys(headers), lambda key: key.isin(STANDARD_HEADERS)))


def is_persistent_connection(headers: Column) -> Column:
    """Exactly ``keep-alive``: the comparison is case-sensitive."""
    value = F.try_element_at(headers, F.lit("Connection"))
    return F.coalesce((value == "keep-alive").cast("int"), F.lit(0))
