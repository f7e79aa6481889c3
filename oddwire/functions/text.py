"""Character statistics of a text column.

Counting removes everything that is not wanted and takes the length of the rest, one
compiled pattern per class. That keeps the work in one pass over the string, where
extracting every match would build an array with one element per character.

A "character" is a UTF-16 unit, so a symbol beyond the basic plane counts as two and is
neither letter, digit nor printable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes.
_NOT_PRINTABLE = r"[^ -~]+"
_NOT_LETTER = r"[\P{L}\x{10000}-\x{10FFFF}]+"
_NOT_DIGIT = r"[\P{Nd}\x{10000}-\x{10FFFF}]+"
_WORD = r"\w+"
_LINE_BREAK = r"\r\n?|\n"


def text_length(text: Column) -> Column:
    """Length in UTF-16 units. Plain ASCII, nearly all traffic, is not transcoded."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(
        (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    )


def printable_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, _NOT_PRINTABLE, ""))


def non_printable_count(text: Column) -> Column:
    return text_length(text) - printable_count(text)


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, _NOT_LETTER, ""))


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, _NOT_DIGIT, ""))


def symbol_count(text: Column) -> Column:
    """Printable characters that are neither letter nor digit.

    Letters and digits are Unicode, printable is ASCII: the count is negative where
    accented letters outnumber the symbols.
    """
    return printable_count(text) - letter_count(text) - digit_count(text)


def _share(count: Column, length: Column) -> Column:
    """count / length, and 0 for an empty or absent text."""
    return F.coalesce(F.try_divide(count.cast("double"), length), F.lit(0.0))


def printable_ratio(text: Column) -> Column:
    return _share(printable_count(text), text_length(text))


def non_printable_ratio(text: Column) -> Column:
    return _share(non_printable_count(text), text_length(text))


def letter_ratio(text: Column) -> Column:
    return _share(letter_count(text), text_length(text))


def digit_ratio(text: Column) -> Column:
    return _share(digit_count(text), text_length(text))


def symbol_ratio(text: Column) -> Column:
    return _share(symbol_count(text), text_length(text))


def all_values(values: Column) -> Column:
    """A list of values as one text. Counts and lengths are sums over the values, so the
    ratio of the joined text is the ratio over the list."""
    return F.array_join(values, "")


def profile_sql(text: str) -> str:
    """The four counts every ratio comes from as one struct, for a text given in SQL."""
    length = (
        f"if(octet_length({text}) = char_length({text}), char_length({text}), "
        f"cast(octet_length(encode({text}, 'UTF-16BE')) / 2 as int))"
    )

    def kept(pattern: str) -> str:
        return f"char_length(regexp_replace({text}, r'{pattern}', ''))"

    return (
        f"named_struct('length', {length}, 'printable', {kept(_NOT_PRINTABLE)}, "
        f"'letters', {kept(_NOT_LETTER)}, 'digits', {kept(_NOT_DIGIT)})"
    )


def two_decimals_sql(count: str, length: str, signed: bool = False) -> str:
    """count / length rounded half up to two decimals, 0 for an empty or absent text.

    Exact in integers: a binary fraction never decides a tie, and no decimal object is built
    for the some 180 ratios of a request. A negative count rounds away from zero.
    """
    size = f"abs({count})" if signed else count
    ratio = f"floor(({size} * 200L + {length}) / ({length} * 2L)) / 100D"
    if signed:
        # Adding zero turns a negative zero into zero.
        ratio = f"sign({count}) * {ratio} + 0D"
    return f"if({length} > 0, {ratio}, 0D)"


def profile_ratios_sql(profile: str) -> dict[str, str]:
    """The five rounded ratios of a profile column, by kind.

    To be selected from a table that already holds the profile: its counts are then computed
    once and the ratios are plain arithmetic.
    """
    p = profile
    counts = {
        "printable_characters": f"{p}.printable",
        "non_printable_characters": f"({p}.length - {p}.printable)",
        "letter": f"{p}.letters",
        "digit": f"{p}.digits",
        "symbol": f"({p}.printable - {p}.letters - {p}.digits)",
    }
    return {
        kind: two_decimals_sql(count, f"{p}.length", signed=kind == "symbol")
        for kind, count in counts.items()
    }


def profile(text: str) -> Column:
    return F.expr(profile_sql(text))


def line_count(text: Column) -> Column:
    """Number of lines, without empty ones at the end; an empty text is one line."""
    trimmed = F.rtrim(text, F.lit("\r\n"))
    return (
        F.when(text == "", 1)
        .when(trimmed == "", 0)
        .otherwise(F.size(F.split(trimmed, _LINE_BREAK)))
    )


def word_gap_count(text: Column) -> Column:
    """Number of pieces left when words are cut out, without empty ones at the end.

    Called "number of words" in the feature table although it counts what lies between
    words: 1 for an empty text, 0 for a single word, 2 for ``a=b``.
    """
    pieces = F.size(F.split(text, _WORD))
    return (
        pieces
        - text.rlike(r"\w\z").cast("int")
        - text.rlike(r"\A\w+\z").cast("int")
    )
