"""The normaliser: markup, quotes, leaders, run-together sentences, line breaks. Every rule is a text stage.

Rules are kept as (pattern, replacement or function of the match, text without which there is no match), so that the
offset map of ``offsets.py`` can follow the same rules that clean the text.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import FLAGS, Stage, each, run, sub
from tessella.functions.languages import Profile

# What marks a token as an address.
ADDRESS = (".com", ".net", ".org", ".io", ".gov", ".edu", "http://", "https://", "@", "www.")
_ATTRIBUTE = r"""\s++[a-zA-Z0-9_:-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^'">\s]++))?+"""


class Edit(NamedTuple):
    """One rule. ``replacement`` is a string, taken as it is, or a function of the match."""

    pattern: str
    replacement: str | Stage
    has: str | None = None

    def of(self, match: Column) -> Column:
        return F.lit(self.replacement) if isinstance(self.replacement, str) else self.replacement(match)

    @property
    def stage(self) -> Stage:
        if isinstance(self.replacement, str):
            return sub(self.pattern, self.replacement.replace("\\", "\\\\").replace("$", "\\$"), self.has)
        return each(self.pattern, self.replacement, self.has)


def _apart(token: Column) -> Column:
    address = F.lower(token)
    found = F.lit(False)
    for word in ADDRESS:
        found = found | address.contains(word)
    return F.when(found, token).otherwise(F.regexp_replace(token, F.lit(FLAGS + r"(?<=[a-z\d])\.(?=[A-Z])"), F.lit(". ")))


HTML = (Edit(rf"</?[a-zA-Z0-9_:-]++(?:{_ATTRIBUTE})*+\s*/?>", "", "<"), Edit(r"&lt;/?[^gt;]*gt;", "", "&lt;"))
INLINE = (Edit(r"\{b\^&gt;\d*&lt;b\^\}|\{b\^>\d*<b\^\}", "", "{b^"),)
QUOTES = (Edit("`", "'", "`"), Edit("''", '"', "''"))
CONTENTS = (Edit(r"\.{4,}\s*\d+-*\d*", "\r", "...."),)
RUNS = (Edit(r"\.{5,}", " ", "....."), Edit("/{3}", "", "///"))
JOINED = (Edit(r"[^ \n\r\t]*[a-z\d]\.[A-Z][^ \n\r\t]*", _apart, "."),)
LINES = (
    Edit(r"\n(?=[a-zA-Z]{1,2}\n)", "", "\n"),
    Edit(r"(?<=\s)\n(?=[a-z(])", "", "\n"),
    Edit(r"\n \n", "\r", "\n"),
    Edit(r"\n\n", "\r", "\n"),
    Edit(r"\n(?=\.\s)", "", "\n"),
    Edit(r"\n", "\r", "\n"),
)
PDF_LINES = (Edit(r"\n(?=•)", "\r", "\n"), Edit(r"(?<=[^\n]\s)\n(?=\S)", "", "\n"), Edit(r"\n(?=[a-z])", " ", "\n"))
ESCAPED = (Edit(r"\\n", "\n", "\\"), Edit(r"\\r", "\r", "\\"), Edit(r"\\ n", "\n", "\\"), Edit(r"\\ r", "\r", "\\"))


def edits(profile: Profile | None = None, doc_type: str = "", custom: Iterable[tuple[str, str]] = ()) -> list[Edit]:
    """All rules in order; ``custom`` ones come before the language's own."""
    own = [Edit(p, r) for p, r in (*custom, *(profile.clean_rules if profile else ()))]
    return [*HTML, *INLINE, *QUOTES, *CONTENTS, *RUNS, *JOINED, *own, *(PDF_LINES if doc_type == "pdf" else LINES), *ESCAPED]


def clean(df: DataFrame, col: str = "text", profile: Profile | None = None, doc_type: str = "", custom: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """``df`` with the column normalised. Null stays null, empty stays empty."""
    return run(df, col, [e.stage for e in edits(profile, doc_type, custom)])
