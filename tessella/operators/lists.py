"""List markers. A marker counts only if its neighbours continue the numbering, so each text's markers become an array
of candidates, and validity is a function of a candidate and the ones beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import FLAGS, run, sub
from tessella.functions.sentinels import LEFT_PAREN, PERIOD, RIGHT_PAREN

# Shapes of list markers.
_LEAD = r"(?:^|[\r\n]|\s)(?:[•⁃\-]\s*)?"
_NUMBERED = FLAGS + _LEAD + r"(?:\(\d{1,3}\)|\d{1,3}(?:\.\)?|\)))(?=\s|$)"
_LETTERED = FLAGS + _LEAD + r"(?:\([a-z]\)|[a-z](?:\.\)?|\)))(?=\s|$)"
_ROMAN_PARENS = "(?Udi)" + _LEAD + r"\([ivxldcm]+\)(?=\s|$)"
_ROMAN_MARKED = "(?Udi)" + _LEAD + r"[ivxldcm]+(?:\.\)?|\))(?=\s|$)"


def _numerals() -> list[str]:
    """Roman numerals from 1 to 100; 81 is known as lxxxxi only."""
    out = []
    for n in range(1, 101):
        text = ""
        for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            while n >= value:
                text, n = text + sign, n - value
        out.append(text)
    out[80] = "lxxxxi"
    return out


ROMAN = _numerals()
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _ordinal(names: list[str], word: Column) -> Column:
    """Place from 0, null if unknown."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.lower(word)).cast("int")
    return F.when(place > 0, place - 1)


def _candidates(df: DataFrame, col: str, pattern: str, ordinal: Callable[[Column], Column]) -> DataFrame:
    """``__m`` matches and ``__g`` gaps (null if none), ``__c``: per match its value, shape and surroundings."""
    text = F.col(col)
    df = df.withColumn("__m", F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn("__g", F.when(F.col("__m").isNotNull(), F.split(text, pattern, -1)))

    def candidate(m: Column, i: Column) -> Column:
        gap = F.get(F.col("__g"), i)
        parens = F.contains(m, F.lit("("))
        return F.struct(
            ordinal(F.regexp_extract(m, r"([^\s().•⁃\-]+)[.)]+$", 1)).alias("v"),
            parens.alias("p"),
            F.when(parens, F.lit("")).otherwise(F.regexp_extract(m, r"(\.\)?|\))$", 1)).alias("d"),
            F.rlike(m, F.lit("[•⁃]")).alias("b"),
            ((i == 0) & (gap == "")).alias("first"),
            F.rlike(gap, F.lit(r"[\r\n]\z")).alias("after_line"),
            F.endswith(F.lower(gap), F.lit("for")).alias("after_for"),
            F.rlike(F.get(F.col("__g"), i + 1), F.lit(FLAGS + r"^\s+[A-Z]")).alias("before_capital"),
            i.alias("i"),
        )

    return df.withColumn("__c", F.transform("__m", candidate))


def _beside(valid: Callable[[Column, Column, Column], Column], links: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """Valid by itself or by what stands beside it; ``links(a, b)``: a, alone, makes both a and the next b valid."""

    def check(x: Column, i: Column) -> Column:
        before, after = F.get(F.col("__k"), i - 1), F.get(F.col("__k"), i + 1)
        yes = lambda c: F.coalesce(c, F.lit(False))
        return yes(valid(x, before, i)) | yes(links(x, after)) | yes(links(before, x))

    return check


def _apply(df: DataFrame, col: str, check: Callable[[Column, Column], Column], unless_for: bool = False) -> DataFrame:
    """Edits the valid ones: a leading space becomes a break, brackets or the period become sentinels."""
    df = df.withColumn("__k", F.filter("__c", lambda x: x["v"].isNotNull()))
    df = df.withColumn("__v", F.transform(F.filter("__k", check), lambda x: x["i"]))

    def edited(x: Column, m: Column) -> Column:
        opens = F.startswith(m, F.lit(" ")) & ~x["first"]
        if unless_for:
            opens = opens & ~x["after_for"]
        lead = F.when(opens, F.concat(F.lit("\r"), F.substr(m, F.lit(2)))).otherwise(m)
        return F.when(x["p"], F.translate(lead, "()", LEFT_PAREN + RIGHT_PAREN)).otherwise(F.translate(lead, ".", PERIOD))

    parts = F.zip_with("__c", "__m", lambda x, m: F.when(F.array_contains(F.col("__v"), x["i"]), edited(x, m)).otherwise(m))
    whole = F.array_join(F.zip_with(F.col("__g"), parts, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return df.withColumn(col, F.when(F.size("__v") > 0, whole).otherwise(F.col(col))).drop("__m", "__g", "__c", "__k", "__v")


_same = lambda a, b: (a["p"] == b["p"]) & (a["p"] | (a["d"] == b["d"]))


def mask_numbered(df: DataFrame, col: str) -> DataFrame:
    """``1.`` ``1)`` ``1.)`` ``(1)``"""
    df = _candidates(df, col, _NUMBERED, lambda w: w.try_cast("int"))
    valid = lambda x, before, i: x["b"] | (before["v"] == x["v"] - 1) & _same(before, x) | (x["v"] == 1) & (x["first"] | x["after_line"])
    return _apply(df, col, _beside(valid, lambda a, b: ~a["b"] & (b["v"] == a["v"] + 1) & _same(a, b)), unless_for=True)


def mask_lettered(df: DataFrame, col: str) -> DataFrame:
    """``a.`` ``a)`` ``a.)`` ``(a)``; the one before need not have the same shape."""
    df = _candidates(df, col, _LETTERED, lambda w: _ordinal(list(LETTERS), w))
    valid = lambda x, before, i: x["b"] | (before["v"] == x["v"] - 1)
    return _apply(df, col, _beside(valid, lambda a, b: ~a["b"] & (b["v"] == a["v"] + 1) & _same(a, b)))


def mask_roman(df: DataFrame, col: str) -> DataFrame:
    """``(i)``, then ``i.`` ``i)`` ``i.)``, of either case."""
    number = lambda w: _ordinal(ROMAN, w)
    follows = lambda a, b: b["v"] == a["v"] + 1
    starts = lambda x: x["first"] | x["after_line"]
    parens = lambda x, before, i: (before["v"] == x["v"] - 1) | (i == 0) & (starts(x) | x["before_capital"])
    marked = lambda x, before, i: (before["v"] == x["v"] - 1) | (i == 0) & (x["v"] == 0) & starts(x)
    df = _apply(_candidates(df, col, _ROMAN_PARENS, number), col, _beside(parens, follows))
    return _apply(_candidates(df, col, _ROMAN_MARKED, number), col, _beside(marked, follows))


def mask_lists(df: DataFrame, col: str) -> DataFrame:
    """Bullets break lines; then Roman, numbered and lettered markers."""
    df = run(df, col, [sub(r"(?<=\S)\s(?=[•⁃])", "\r")])
    return mask_lettered(mask_numbered(mask_roman(df, col), col), col)
