"""The string-level interface: one text in, sentences or spans out, through the same plans that run over tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.sentinels import unmask
from tessella.operators import cleaning, offsets
from tessella.operators import segment as plans
from tessella.operators.chunks import segment_chunks


@dataclass(frozen=True, slots=True)
class TextSpan:
    """A sentence and its place; two are equal if text and raw place are."""

    sent: str
    start: int
    end: int
    clean_start: int | None = field(default=None, compare=False)
    clean_end: int | None = field(default=None, compare=False)
    raw_slice: str | None = field(default=None, compare=False)
    trailing_delim: str = field(default="", compare=False)


@dataclass(frozen=True, slots=True)
class OffsetMap:
    """Places in cleaned text to places in raw text: each key's delta holds from it up to the next key."""

    clean_keys: tuple[int, ...]
    cum_deltas: tuple[int, ...]
    raw_length: int
    clean_length: int

    @classmethod
    def identity(cls, length: int) -> OffsetMap:
        return cls((), (), length, length)

    def _column(self) -> Column:
        keys = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(d).alias("delta")) for k, d in zip(self.clean_keys, self.cum_deltas)]).cast(offsets._KEYS)
        return F.struct(keys.alias("keys"), F.lit(self.raw_length).alias("raw_length"), F.lit(self.clean_length).alias("clean_length"))

    def clean_to_raw(self, index: int) -> int:
        _session()
        return _one(None).select(offsets.to_raw(self._column(), F.lit(index))).first()[0]

    def clean_span_to_raw_span(self, start: int, end: int) -> tuple[int, int]:
        _session()
        row = _one(None).select(offsets.span_to_raw(self._column(), F.lit(start), F.lit(end)).alias("s")).first()["s"]
        return row["start"], row["end"]


@dataclass(frozen=True, slots=True)
class NormalizationResult:
    text: str
    offset_map: OffsetMap


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _one(text: str | None) -> DataFrame:
    return _session().createDataFrame([(text,)], "text string")


def normalize(text: str | None, *, config: plans.Language = None, doc_type: str = "", custom_rules: Iterable[tuple[str, str]] = ()) -> str | None:
    return cleaning.clean(_one(text), "text", plans.profile(config), doc_type, custom_rules).first()["text"]


def normalize_with_map(text: str, *, config: plans.Language = None, doc_type: str = "", custom_rules: Iterable[tuple[str, str]] = ()) -> NormalizationResult:
    if not text:
        return NormalizationResult("", OffsetMap.identity(0))
    row = offsets.clean_with_map(_one(text), "text", "clean", plans.profile(config), doc_type, custom_rules).first()
    m = row["__map"]
    return NormalizationResult(row["clean"], OffsetMap(tuple(k.key for k in m["keys"]), tuple(k.delta for k in m["keys"]), m.raw_length, m.clean_length))


def disambiguate(text: str, *, config: plans.Language = None, char_span: bool = False) -> tuple:
    """Trimmed sentences, or their places."""
    if not text:
        return ()
    spans = plans.disambiguate(_one(text), "text", config).select(F.transform("__spans", lambda s: F.struct(s["start"], s["end"], unmask(s["sent"]).alias("sent"))).alias("s")).first()["s"]
    return tuple((s[0], s[1]) for s in spans) if char_span else tuple(s["sent"] for s in spans)


@dataclass(frozen=True)
class Segmenter:
    """Options of a segmentation. ``transform`` adds sentences to a table; ``segment`` and ``stream`` take one text."""

    language: plans.Language = "en"
    clean: bool = False
    doc_type: str = ""
    char_span: bool = False

    def __post_init__(self) -> None:
        plans.check_options(self.language, self.clean, self.doc_type)

    @property
    def _options(self) -> dict:
        return {"language": self.language, "clean": self.clean, "doc_type": self.doc_type, "char_span": self.char_span}

    def transform(self, df: DataFrame, text_col: str = "text", out: str = "sentences") -> DataFrame:
        return plans.segment(df, text_col, out=out, **self._options)

    def _items(self, rows: Iterable) -> Iterator[str | TextSpan]:
        for row in rows:
            yield from (TextSpan(**s.asDict()) if self.char_span else s for s in row["sentences"])

    def segment(self, text: str = "") -> tuple[str, ...] | tuple[TextSpan, ...]:
        return tuple(self._items(self.transform(_one(text)).select("sentences").collect()))

    def stream(self, text: str = "", *, chunk_paragraphs: int = 1000) -> Iterator[str | TextSpan]:
        """Chunk by chunk, so that only one chunk's sentences are here at a time."""
        rows = segment_chunks(_one(text), paragraphs=chunk_paragraphs, **self._options).orderBy("chunk").select("sentences")
        yield from self._items(rows.toLocalIterator())
