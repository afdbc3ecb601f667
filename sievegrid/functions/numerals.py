"""Numbers written as list labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "零一二三四五六七八九"


def _places(n: Column, names: tuple[tuple[str, ...], ...]) -> Column:
    """Digits of n from the highest place on, each written by its place's own names."""
    top = len(names) - 1
    return F.concat(*[F.get(F.array(*[F.lit(x) for x in own]), (F.floor(n / 10 ** (top - i)) % 10).cast("int")) for i, own in enumerate(names)])


def to_chinese(n: Column) -> Column:
    """1 to 9999 as a Chinese numeral, larger ones as digits, others as 零."""
    written = _places(n, tuple(("零", *(d + unit for d in _DIGITS[1:])) for unit in ("千", "百", "十", "")))
    written = F.regexp_replace(F.regexp_replace(written, "零+", "零"), "^零|零$", "")
    return F.when(n <= 0, "零").when(n >= 10000, n.cast("string")).otherwise(F.regexp_replace(written, "^一十", "十"))


def to_roman(n: Column) -> Column:
    """1 to 3999 in Roman numerals; larger ones repeat the thousands."""

    def place(one: str, five: str, ten: str) -> tuple[str, ...]:
        return "", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten

    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), _places(n % 1000, (place("C", "D", "M"), place("X", "L", "C"), place("I", "V", "X"))))


def list_label(n: Column, form: str) -> Column:
    """A counter in a word processor's number format."""
    letter = F.char((n - 1) % 26 + 97)
    made = {
        "decimal": n.cast("string"),
        "chineseCounting": to_chinese(n),
        "chineseCountingThousand": to_chinese(n),
        "japaneseCounting": to_chinese(n),
        "upperRoman": to_roman(n),
        "lowerRoman": F.lower(to_roman(n)),
        "upperLetter": F.upper(letter),
        "lowerLetter": letter,
        "decimalEnclosedCircle": F.when(n.between(1, 10), F.substring(F.lit("①②③④⑤⑥⑦⑧⑨⑩"), n.cast("int"), F.lit(1))).otherwise(n.cast("string")),
        "bullet": F.lit(""),
        "none": F.lit(""),
    }
    return made.get(form, n.cast("string"))
