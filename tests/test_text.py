import random
import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from oddwire.functions import text
from oddwire.operators.features import text_features

WORD = re.compile(r"\w+", re.ASCII)


def units(char: str) -> int:
    return len(char.encode("utf-16-be")) // 2


def java_pieces(value: str, pattern: str) -> int:
    """Number of pieces between matches, without empty ones at the end."""
    if value == "":
        return 1
    pieces = re.split(pattern, value, flags=re.ASCII)
    while pieces and pieces[-1] == "":
        pieces.pop()
    return len(pieces)


def brute(value: str) -> tuple:
    basic = [c for c in value if ord(c) < 0x10000]
    length = sum(units(c) for c in value)
    printable = sum(" " <= c <= "~" for c in value)
    letters = sum(unicodedata.category(c).startswith("L") for c in basic)
    digits = sum(unicodedata.category(c) == "Nd" for c in basic)
    return (
        length, printable, length - printable, letters, digits, printable - letters - digits,
        java_pieces(value, r"\r\n|\r|\n"), java_pieces(value, r"\w+"),
    )


def samples() -> list[str]:
    draw = random.Random(7)
    alphabet = "abZ09_ .,=&/%\n\r\tñéß中١ 😀𝒜"
    fixed = ["", "abc", "a=b", "=a", "a=", "\n", "\r\n", "a\n\n", "\na", "a\r\nb\rc\n", "ñ", "😀", "a b c", " "]
    return fixed + ["".join(draw.choices(alphabet, k=draw.randrange(1, 30))) for _ in range(400)]


def test_counts_match_brute_force(spark):
    values = samples()
    c = F.col("s")
    rows = (
        spark.createDataFrame(list(enumerate(values)), "i int, s string")
        .select(
            "i", text.text_length(c), text.printable_count(c), text.non_printable_count(c),
            text.letter_count(c), text.digit_count(c), text.symbol_count(c),
            text.line_count(c), text.word_gap_count(c),
        )
        .collect()
    )
    for row in rows:
        assert tuple(row)[1:] == brute(values[row["i"]]), repr(values[row["i"]])


def test_rounded_ratios_are_half_up(spark):
    values = samples() + ["a" * 1 + "." * 7, "." * 143 + "a" * 57, "ñ" * 3 + "a" * 5]
    rows = text_features(
        spark.createDataFrame(list(enumerate(values)), "i int, s string"), "s", "i"
    ).collect()
    for row in rows:
        length, *counts = brute(values[row["i"]])[:6]
        assert row["length_s"] == length
        for value, count in zip(tuple(row)[2:], counts):
            exact = Decimal(count) / Decimal(length) if length else Decimal(0)
            assert value == float(exact.quantize(Decimal("0.01"), ROUND_HALF_UP))
            assert str(value) != "-0.0"


@pytest.mark.parametrize("ratio", ["printable", "non_printable", "letter", "digit", "symbol"])
def test_ratio_over_a_list_sums_counts_and_lengths(spark, ratio):
    column = getattr(text, f"{ratio}_ratio")
    frame = spark.createDataFrame([(["ab1", "", "é-"],), (["", ""],), ([],)], "v array<string>")
    mixed, empty, none = [r[0] for r in frame.select(column(text.all_values(F.col("v")))).collect()]
    expected = {"printable": 4, "non_printable": 1, "letter": 3, "digit": 1, "symbol": 0}[ratio] / 5
    assert mixed == expected
    assert empty == 0.0 and none == 0.0


def test_symbol_ratio_of_an_accented_letter_is_negative(spark):
    frame = spark.createDataFrame([("ñ",)], "s string")
    assert frame.select(text.symbol_ratio(F.col("s"))).first()[0] == -1.0
