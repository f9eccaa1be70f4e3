"""Language profiles: word lists from data files, and the patterns that differ between languages.

Patterns are in Java's dialect. ``Profile.load`` reads other word lists from a file of the same shape.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, replace
from functools import lru_cache
from importlib import resources
from pathlib import Path

from tessella.functions.sentinels import ARABIC_COMMA, COLON, EXCLAMATION, PERIOD, QUESTION

CODES = ("en", "am", "ar", "bg", "da", "de", "el", "es", "fa", "fr", "hi", "hy", "it", "ja", "kk", "mr", "my", "nl", "pl", "ru", "sk", "ur", "zh")

_CAP = "А-ЯЁ"
_INITIAL = (rf"((?:^|(?<=\s))[{_CAP}])\.(?=\s)", "$1" + PERIOD)
_BEFORE = "(?:^|(?<=\\s))"
# Month names, marks and patterns by language.
_DE_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
_SK_MONTHS = (
    "Január|Február|Marec|Apríl|Máj|Jún|Júl|August|September|Október|November|December|"
    "Januára|Februára|Marca|Apríla|Mája|Júna|Júla|Augusta|Septembra|Októbra|Novembra|Decembra"
)
_COLON_COMMA = ((r"(?<=\d):(?=\d)", COLON), (r"،(?=\s\S+،)", ARABIC_COMMA))
_LOW_QUOTE = r"„(?:[^“\\]++|\\\\|\\.)“"
_PATTERNS: dict[str, dict] = {
    "ar": {"marks": "!.:?،؟", "rules": _COLON_COMMA},
    "fa": {"marks": "!.:?؟", "rules": _COLON_COMMA},
    "ur": {"marks": "!?؟۔"},
    "hi": {"marks": "!.?|।"},
    "mr": {"marks": "!.?"},
    "am": {"marks": "!?።፧"},
    "my": {"marks": "!?။၏"},
    "hy": {"marks": ":՜։"},
    "el": {"marks": "!.;?"},
    "bg": {"all_periods": True, "initialism": r"\b[\u0400-\u04ff]+(?:\.[\u0400-\u04ff]+)+[.]?", "rules": (_INITIAL,)},
    "ru": {"all_periods": True, "initialism": r"\b[\u0400-\u04ff]+(?:\.[\u0400-\u04ff]+)+[.]?", "rules": (_INITIAL,)},
    "kk": {
        "all_periods": True,
        "initialism": r"\b[\u0400-\u0500]+(?:\.\s?[\u0400-\u0500])+[.]|\b[a-z](?:\.[a-z])+[.]",
        "rules": (_INITIAL, (r"\?(?=\s*[-—]\s*)", QUESTION), (r"!(?=\s*[-—]\s*)", EXCLAMATION)),
    },
    "da": {"rules": ((r"(\s-?\d{1,2})\.(?=\s)", "$1" + PERIOD),)},
    "de": {
        "all_periods": True,
        "pairs": (_LOW_QUOTE, r",,(?:[^“\\]++|\\\\|\\.)“"),
        "rules": (
            (r"(?<=Co)\.(?=\s*(?:KG|GmbH|OHG|AG)\b)", PERIOD),
            (rf"(?<=\d)\.(?=\s*(?:{_DE_MONTHS}))", PERIOD),
            (rf"({_BEFORE}-?\d{{1,2}})\.(?=\s)", "$1" + PERIOD),
            (rf"({_BEFORE}[a-z])\.(?=\s)", "$1" + PERIOD),
        ),
    },
    "sk": {
        "all_periods": True,
        "pairs": (_LOW_QUOTE,),
        "rules": (
            (rf"(?<=\d)\.(?=\s*(?:{_SK_MONTHS}))", PERIOD),
            (r"(?<=\d)\.(?=\s*[a-z]+)", PERIOD),
            (rf"({_BEFORE}[VXI]+)\.(?=\s+)", "$1" + PERIOD),
        ),
    },
    "ja": {"pairs": ("（(?:[^（）]++|\\\\\\\\|\\\\.)）", "「(?:[^「」]++|\\\\\\\\|\\\\.)」"), "clean_rules": ((r"(?<=の)\n(?=\S)", ""),)},
    "zh": {"pairs": ("《(?:[^》\\\\]++|\\\\\\\\|\\\\.)》", "「(?:[^」\\\\]++|\\\\\\\\|\\\\.)」")},
}


@dataclass(frozen=True)
class Profile:
    """What a language adds. ``marks``: its own sentence ends (empty: the default ones)."""

    code: str
    abbreviations: tuple[str, ...] = ()
    prepositive: tuple[str, ...] = ()
    number: tuple[str, ...] = ()
    starters: tuple[str, ...] = ()
    marks: str = ""
    all_periods: bool = False
    pairs: tuple[str, ...] = ()
    rules: tuple[tuple[str, str], ...] = ()
    clean_rules: tuple[tuple[str, str], ...] = ()
    initialism: str = ""

    @staticmethod
    def load(path: str, code: str = "") -> Profile:
        """A profile whose word lists come from a TOML file: ``abbreviations``, ``prepositive``, ``number``, ``starters``
        (the long names with ``_abbreviations``, and ``sentence_starters``, do too)."""
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        code = code or data.get("iso_code") or Path(path).stem
        base = profile(code) if code in CODES else Profile(code)
        named = lambda *keys: tuple(str(x) for k in keys for x in data.get(k, ()))
        return replace(
            base,
            abbreviations=named("abbreviations"),
            prepositive=named("prepositive", "prepositive_abbreviations"),
            number=named("number", "number_abbreviations"),
            starters=named("starters", "sentence_starters"),
        )


@lru_cache(maxsize=64)
def _shipped(code: str) -> Profile:
    file = resources.files("tessella.functions") / "profiles" / f"{code}.toml"
    words = tomllib.loads(file.read_text(encoding="utf-8")) if file.is_file() else {}
    return Profile(code, **{k: tuple(v) for k, v in words.items()}, **_PATTERNS.get(code, {}))


def profile(language: str | Profile | None) -> Profile | None:
    """A code's profile; a profile passes through; nothing gives none (default rules)."""
    if not language:
        return None
    if isinstance(language, Profile):
        return language
    if language not in CODES:
        raise ValueError(f"Provide valid language ID, not {language!r}: there are profiles for {', '.join(CODES)}")
    return _shipped(language)
