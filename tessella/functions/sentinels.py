"""Private-use code points that stand for punctuation that does not end a sentence, one for one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinels.
PERIOD, EXCLAMATION, QUESTION = "\ue000", "\ue004", "\ue005"
LEFT_PAREN, RIGHT_PAREN = "\ue008", "\ue009"
NEWLINE, END = "\ue00a", "\ue00b"
ARABIC_COMMA, COLON = "\ue00c", "\ue00d"
ELLIPSIS_DOT, ELLIPSIS_SPACE = "\ue020", "\ue021"

# What each sentinel restores to.
_ONE_FOR_ONE = {
    "\ue000": ".", "\ue001": "。", "\ue002": "．", "\ue003": "！", "\ue004": "!", "\ue005": "?",
    "\ue006": "？", "\ue007": "'", "\ue008": "(", "\ue009": ")", "\ue00a": "\n", "\ue00c": "،", "\ue00d": ":",
    "\ue020": ".", "\ue021": " ",
}
_DOUBLE = {"\ue010": "?!", "\ue011": "!?", "\ue012": "??", "\ue013": "!!"}

_MASKED = ".!?。！？．"
_MASKS = "\ue000\ue004\ue005\ue001\ue003\ue006\ue002"

#: Sentinels that count as punctuation when a line is searched for any.
SEARCHED = "\ue000\ue004\ue005\ue010\ue011\ue012\ue013\ue00b"


def mask(text: Column) -> Column:
    """Every sentence-ending mark replaced by its sentinel."""
    return F.translate(text, _MASKED, _MASKS)


def unmask(text: Column) -> Column:
    """Sentinels back to what they stand for; the end sentinel is deleted."""
    out = F.translate(text, "".join(_ONE_FOR_ONE) + END, "".join(_ONE_FOR_ONE.values()))
    doubles = out
    for sentinel, pair in _DOUBLE.items():
        doubles = F.replace(doubles, F.lit(sentinel), F.lit(pair))
    return F.when(F.rlike(out, F.lit("[\ue010-\ue013]")), doubles).otherwise(out)
