"""From masked text to sentence spans: lines, boundary matches, quotes inside matches, and stray marks that join the
sentence before them. Everything happens inside a document's row, so no shuffle brings its pieces together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import FLAGS, let
from tessella.functions.languages import Profile
from tessella.functions.sentinels import ELLIPSIS_SPACE, END, EXCLAMATION, NEWLINE, PERIOD, QUESTION, SEARCHED

_MARKS = ".!?。．！？"
_BREAK = rf"\r\n|\r|\n|{NEWLINE}"
_WS = rf"[\s\x1c-\x1f{ELLIPSIS_SPACE}{END}]"
# What a sentence is, alternatives in order.
_DEFAULT = (
    r"（[^）]*）(?=\s?[A-Z])|「[^」]*」(?=\s[A-Z])|\([^)]{2,}\)(?=\s[A-Z])|'[^']*[^,]'(?=\s[A-Z])|\"[^\"]*[^,]\"(?=\s[A-Z])|“[^”]*[^,]”(?=\s[A-Z])"
    rf"|[。．.！!?？ ]{{2,}}|\S.*?[.。．！!?？{END}{NEWLINE}]+|[.。．！!?？]"
)
_QUOTED = rf"[!?.\-{PERIOD}{EXCLAMATION}{QUESTION}][\"“”]"
_SPANS = "array<struct<start:int,end:int,sent:string>>"


def _class(marks: str) -> str:
    return "[" + "".join("\\" + m if ord(m) < 128 else m for m in marks) + "]"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(rf"(?U)^{_WS}+|{_WS}+\z"), F.lit(""))


def _lead(c: Column) -> Column:
    return F.length(F.regexp_extract(c, rf"(?U)^{_WS}+", 0))


def lines(df: DataFrame, col: str) -> DataFrame:
    """Adds ``__lines``: an array of line and its start."""
    text = F.col(col)
    df = df.withColumn("__l", F.split(text, _BREAK, -1)).withColumn("__s", F.regexp_extract_all(text, F.lit(_BREAK), F.lit(0)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    widths = F.zip_with("__l", "__s", lambda line, sep: F.length(line) + F.coalesce(F.length(sep), F.lit(0)))
    starts = F.aggregate(widths, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    df = df.withColumn("__a", F.when(F.size("__l") == 1, F.array(F.lit(0))).otherwise(starts))
    return df.withColumn("__lines", F.arrays_zip(F.col("__l").alias("line"), F.col("__a").alias("at"))).drop("__l", "__s", "__a")


def _pieces(line: Column, boundary: str, marks: str) -> Column:
    """Boundary matches, cut again after quotes: gap before, length, leading blanks, trimmed length, whether it says anything."""
    closed = F.when(F.rlike(line, F.lit(_class(marks) + r"\z")), line).otherwise(F.concat(line, F.lit(END)))

    def cut(closed: Column) -> Column:
        def parts(gap: Column, match: Column) -> Column:
            text = F.regexp_replace(match, F.lit(rf"{END}\z"), F.lit(""))
            again = lambda t: F.when(F.rlike(t, F.lit(FLAGS + _QUOTED + r"\s[A-Z]")), F.split(t, FLAGS + rf"(?<={_QUOTED})\s(?=[A-Z])", -1)).otherwise(F.array(t))
            piece = lambda x, i: F.struct(F.when(i == 0, F.length(gap)).otherwise(1).alias("gap"), F.length(x).alias("n"), _lead(x).alias("lead"), F.length(_trim(x)).alias("core"), F.rlike(x, F.lit(r"(?U)\w")).alias("says"))
            return F.when(match.isNotNull(), F.transform(let(text, again), piece))

        both = F.zip_with(F.split(closed, FLAGS + boundary, -1), F.regexp_extract_all(closed, F.lit(FLAGS + boundary), F.lit(0)), parts)
        return F.flatten(F.filter(both, lambda x: x.isNotNull()))

    return let(closed, cut)


def _islands(pieces: Column) -> Column:
    """Spans of pieces; a piece that says nothing extends the span before it, if there is one."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"] + x["lead"]
        out = acc["out"]
        last = F.element_at(out, -1)
        opened = F.concat(out, F.array(F.struct(s.alias("s"), (s + x["core"]).alias("e"))))
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["s"].alias("s"), (s + x["core"]).alias("e"))))
        new = F.when(x["core"] == 0, out).when(x["says"] | (F.size(out) == 0), opened).otherwise(joined)
        return F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), new.alias("out"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def _line_spans(line: Column, at: Column, boundary: str, marks: str) -> Column:
    whole = lambda core: F.array(F.struct((at + _lead(line)).alias("start"), (at + _lead(line) + F.length(core)).alias("end"), core.alias("sent")))
    plain = ~F.rlike(line, F.lit(r"(?U)\w")) | ~F.rlike(line, F.lit(_class(marks + SEARCHED)))
    found = lambda spans, core: F.when(F.size(spans) > 0, F.transform(spans, lambda x: F.struct((at + x["s"]).alias("start"), (at + x["e"]).alias("end"), F.substring(line, x["s"] + 1, x["e"] - x["s"]).alias("sent")))).otherwise(whole(core))
    return let(_trim(line), lambda core: F.when(core == "", F.array().cast(_SPANS)).when(plain, whole(core)).otherwise(let(_islands(_pieces(line, boundary, marks)), lambda spans: found(spans, core))))


def split(df: DataFrame, col: str, p: Profile | None = None) -> DataFrame:
    """Adds ``__spans``: start, end (code points) and masked text of each sentence, trimmed. Null text: empty."""
    own = p.marks if p and p.marks else ""
    marks, boundary = own or _MARKS, rf".*?{_class(own)}|.+$" if own else _DEFAULT
    df = lines(df, col)
    spans = F.flatten(F.transform("__lines", lambda x: _line_spans(x["line"], x["at"], boundary, marks)))
    df = df.withColumn("__found", F.coalesce(spans, F.array().cast(_SPANS)))
    core = _trim(F.col(col))
    only = F.when(F.coalesce(core, F.lit("")) == "", F.array().cast(_SPANS)).otherwise(F.array(F.struct(_lead(F.col(col)).alias("start"), (_lead(F.col(col)) + F.length(core)).alias("end"), core.alias("sent"))))
    return df.withColumn("__spans", F.when(F.size("__found") > 0, F.col("__found")).otherwise(only)).drop("__lines", "__found")
