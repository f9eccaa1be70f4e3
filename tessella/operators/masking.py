"""Masking: periods and marks that do not end a sentence become sentinels of the same length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import FLAGS, Stage, any_of, each, run, sub
from tessella.functions.languages import Profile, profile as named
from tessella.functions.sentinels import ELLIPSIS_DOT as D
from tessella.functions.sentinels import ELLIPSIS_SPACE as S
from tessella.functions.sentinels import EXCLAMATION, PERIOD, QUESTION, mask

# Contexts of an abbreviation's period.
_LEFT = r"(?:^|(?<=[\s(\[{—–\-\"'“‘]))"
_OPEN = r"(?:^|[\s(\[{—–\-\"'“‘])"
_BIDI = r"\u200e\u200f\u202a-\u202e\u2066-\u2069"
_GOES_ON = r"""(?=[.:\-?,!"'“”«»]|\s+(?:[a-zа-яё\u0600-\u06ff]|I\s|I'm|I'll|\d|\(|"|'|«|„))"""
_ACRONYMS = rf"U{PERIOD}S|U\.S|U{PERIOD}K|E{PERIOD}U|E\.U|U{PERIOD}S{PERIOD}A|U\.S\.A|I|i{PERIOD}v|I{PERIOD}V|i\.v|I\.V"
_INITIALISM = r"(?Udi)\b[a-zA-Z\u0400-\u0500](?:\.[a-zA-Z\u0400-\u0500])+\."
_FILES = (
    "jpe?g|png|gif|tiff?|pdf|ps|docx?|xlsx?|svg|bmp|tga|exif|odt|html?|txt|rtf|bat|sxw|xml|zip|exe|msi|blend|wmv|"
    "mp[34]|pptx?|flac|rb|cpp|cs|js"
)
# Words that hold an exclamation mark.
_EXCLAIMED = ("!Kung-Ekoka", "!Xuun", "!Kung", "!Xun", "!Xũ", "Yahoo!", "Yum!", "Y!J")


def _dots(match: Column) -> Column:
    return F.translate(match, ".", PERIOD)


POSSESSIVE: Stage = sub(r"\.(?=(?:'s|’s|'S|’S)\b)", PERIOD)
COMPANY: Stage = sub(r"(?Udi)(?<=Co)\.(?=\s*(?:KG|GmbH|OHG|AG)\b)", PERIOD, "o.")
INITIALS: Stage = each(rf"(?:^|(?<=[\s{PERIOD}(\[{{—–\-\"'“‘]))(?:[A-ZА-ЯЁ]\.)+(?=[,.:\-?!]|\s|\s*$)", _dots, ".")
# a pattern that starts with the period is tried at periods only, and looks back from there
SINGLE_LOWER: Stage = sub(rf"\.(?<={_OPEN}[a-zа-яё]\.)(?=\s+[a-zA-Zа-яёА-ЯЁ]|\s*$)", PERIOD, ".")
HOURS: Stage = sub(rf"(?<=\b[AaPp]{PERIOD}[Mm]){PERIOD}(?=\s[A-Z])", ".", PERIOD)


def initialisms(p: Profile | None) -> Stage:
    return each(FLAGS + p.initialism if p and p.initialism else _INITIALISM, _dots, ".")


def lexicon(p: Profile | None) -> list[Stage]:
    """The word lists. Compound entries need alternatives; single words are one scan with a set lookup per token."""
    words = lambda *lists: {w.strip() for ws in lists for w in ws if w.strip()}
    p = p or Profile("")
    if p.all_periods:
        every = words(p.abbreviations, p.prepositive, p.number)
        bare = {w for w in every if not w.endswith(".")}
        out = [each(rf"(?Udi)\b(?:{any_of(bare)})\.", _dots, ".")] if bare else []
        dotted = {w for w in every if "." in w}  # entries without a period have none to mask
        return out + ([each(rf"(?Udi)\b(?:{any_of(every)})", _dots, ".")] if dotted else [])
    compound = {w for w in words(p.abbreviations, p.prepositive, p.number) if "." in w or " " in w}
    known = {w.lower() for w in compound}
    single = lambda ws: {w for w in words(ws) if w.lower() not in known}
    out: list[Stage] = []
    if compound:
        out.append(each(rf"{_LEFT}(?iu:{any_of(compound)})[{_BIDI}]*\.?[{_BIDI}]*{_GOES_ON}", _dots, "."))
    if ahead := single(p.prepositive):
        out.append(sub(rf"\.(?<={_OPEN}(?iu:{any_of(ahead)})\.)(?=\s|:\d+)", PERIOD, "."))
    if counted := single(p.number):
        out.append(sub(rf"\.(?<={_OPEN}(?iu:{any_of(counted)})\.)(?=\s*\d|\s+\()", PERIOD, "."))
    default = named("en").abbreviations
    plain = sorted({w.lower() for w in single(p.abbreviations or default)})

    def standard(match: Column) -> Column:
        word = F.lower(F.regexp_extract(match, rf"^[^.{_BIDI}]+", 0))
        return F.when(word.isin(plain), _dots(match)).otherwise(match)

    out.append(each(rf"{_LEFT}[^\s.{_BIDI}]+[{_BIDI}]*\.[{_BIDI}]*{_GOES_ON}", standard, "."))
    return out


def starters(p: Profile | None) -> list[Stage]:
    """An acronym's last period is one again before a word that opens sentences."""
    if not p or not p.starters:
        return []
    return [sub(rf"({_ACRONYMS}){PERIOD}(?=\s+(?:{any_of(p.starters)})\b)", "$1.", PERIOD)]


def abbreviations(p: Profile | None) -> list[Stage]:
    return [POSSESSIVE, COMPANY, INITIALS, initialisms(p), *lexicon(p), SINGLE_LOWER, HOURS, *starters(p)]


def _reference(match: Column) -> Column:
    core = F.regexp_replace(match, F.lit(FLAGS + r"\s+\z"), F.lit(""))
    return F.concat(F.lit(PERIOD), F.substr(core, F.lit(2)), F.repeat(F.lit("\r"), F.length(match) - F.length(core)))


DECIMALS: list[Stage] = [
    sub(r"\.(?=\d)", PERIOD, "."),
    sub(r"(?<=\d)\.(?=\S)", PERIOD, "."),
    sub(r"((?:^|(?<=[\r\n\ue00a]))\d{1,3})\.(?=\s\S|\))", "$1" + PERIOD, "."),
]
REFERENCES: Stage = each(rf"(?<=[^\d\s])[.{PERIOD}](?:(?:\[(?:\d{{1,3}},?\s?-?\s?)*\b\d{{1,3}}\])+|(?:\d{{1,3}}\s?)?\d{{1,3}})\s*(?=[A-Z]|\z|$)", _reference)


def numbers(p: Profile | None) -> list[Stage]:
    return [*DECIMALS, REFERENCES, *[sub(a, b) for a, b in (p.rules if p else ())]]


EXCLAIMED: list[Stage] = [lambda c, w=w: F.replace(c, F.lit(w), F.lit(w.replace("!", EXCLAMATION))) for w in _EXCLAIMED]


def _cited(match: Column) -> Column:
    opened = F.regexp_replace(match, F.lit(FLAGS + r"\s(?=\()"), F.lit("\r"))
    return F.regexp_replace(opened, F.lit(FLAGS + r"(?<=\))\s"), F.lit("\r"))


CITED: Stage = each(r'["”]\s\([^)]*\)\s["“]', _cited, "(")

# What stands inside a pair, by its marks.
DOUBLE_QUOTES: Stage = each(r'"(?:[^"\r\n\\]++|\\\\|\\.)"', mask, '"')
_PAIRS: list[Stage] = [
    DOUBLE_QUOTES,
    each(r"«(?:[^»\r\n\\]++|\\\\|\\.)»", mask, "«"),
    each(r"“(?:[^”\r\n\\]++|\\\\|\\.)”", mask, "“"),
    each(r"\[(?:[^\]\r\n\\]++|\\\\|\\.)\]", mask, "["),
    each(r"\((?:[^()\r\n\\]++|\\\\|\\.)\)", mask, "("),
    each(r"(?:^|(?<=\s))‘(?!\s)[^’\n\r]+(?:(?<=[a-zA-Z])’(?=[a-zA-Z])[^’\n\r]+)*’(?=[\s.,!?;:)\]]|$)", mask, "‘"),
    each(r"--[^-\r\n]*+--", mask, "--"),
]
_SINGLE = each(r"(?:^|(?<=\s))'(?!\s)[^'\n\r]+(?:(?<=[a-zA-Z])'(?=[a-zA-Z])[^'\n\r]+)*'(?=[\s.,!?;:)\]]|$)", mask, "'")


def _single_quotes(c: Column) -> Column:
    """Not where an apostrophe opens a word and none is followed by a space."""
    opens = F.rlike(c, F.lit(FLAGS + r"(?<=\s)'[^']*+'\S")) & ~F.rlike(c, F.lit(FLAGS + r"'\s"))
    return F.when(c.contains("'") & ~opens, _SINGLE(c)).otherwise(c)


def pairs(p: Profile | None) -> list[Stage]:
    return [CITED, _single_quotes, *_PAIRS, *[each(x, mask) for x in (p.pairs if p else ())]]


ELLIPSES: list[Stage] = [
    sub(r"(?:\s\.){3}\s", S + D + S + D + S + D + S, "."),
    sub(r"(?<=[a-z])(?:\.\s){3}\.(?=$|\n)", D + S + D + S + D + S + D, "."),
    sub(r"(?<=\S)\.{4}(?=\s+[A-Z])", D * 3 + ".", "...."),
    sub(r"\.\.\.(?=\s+[A-Z])", D * 2 + ".", "..."),
    sub(r"\.\.\.", D * 3, "..."),
]
COMMON: list[Stage] = [
    sub(r"(?<=[a-zA-Z]°)\.(?=\s*\d+)", PERIOD, "°"),
    sub(rf"(?<=\s)\.(?=(?:{_FILES})\s)", PERIOD, "."),
    sub(r"""\?(?=['"])""", QUESTION, "?"),
    sub(r"""!(?=['"])""", EXCLAMATION, "!"),
    sub(r"!(?=,\s[a-z])", EXCLAMATION, "!"),
    sub(r"!(?=\s[a-z])", EXCLAMATION, "!"),
    sub(r"(?<=[a-zA-Z0-9_])\.(?=[a-zA-Z0-9_])", PERIOD, "."),
]


def has_any(c: Column, *marks: str) -> Column:
    out = c.contains(marks[0])
    for m in marks[1:]:
        out = out | c.contains(m)
    return out


def when(condition: Column, stages: list[Stage]) -> list[Stage]:
    """Stages that run only where a condition on the original text holds."""
    return [lambda c, s=s: F.when(condition, s(c)).otherwise(c) for s in stages]


def flags(df: DataFrame, col: str) -> DataFrame:
    """Which marks the text has before any is masked; later stages ask these, not the masked text."""
    c = F.col(col)
    df = df.withColumns({"__period": has_any(c, ".", "．", "。"), "__excl": has_any(c, "!", "！"), "__quest": has_any(c, "?", "？"), "__line": has_any(c, "\n")})
    return df.withColumn("__punct", F.col("__period") | F.col("__excl") | F.col("__quest"))


FLAG_COLUMNS = ("__period", "__excl", "__quest", "__line", "__punct")


def mask_abbreviations(df: DataFrame, col: str, p: Profile | None) -> DataFrame:
    return run(df, col, when(F.col("__period"), abbreviations(p)))


def mask_rest(df: DataFrame, col: str, p: Profile | None) -> DataFrame:
    """Numbers, exclaimed words, pairs, ellipses and common marks, in this order."""
    own = bool(p and p.rules)
    counted = F.lit(True) if own else F.col("__period")
    df = run(df, col, when(counted & (F.lit(own) | F.rlike(F.col(col), F.lit(FLAGS + r"\d"))), numbers(p)))
    df = run(df, col, when(F.col("__excl"), EXCLAIMED))
    df = run(df, col, when(F.lit(True) if p and p.pairs else F.col("__punct"), pairs(p)))
    return run(df, col, when(F.col("__punct") | F.col("__line"), [*ELLIPSES, *COMMON]))
