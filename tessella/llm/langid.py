"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; its n-grams of one to ``N`` characters hash into ``BUCKETS`` columns. Training counts them by
language on the executors; the driver gets only the summed table (languages x buckets) and broadcasts its logarithms.
Scoring is a sparse product in numpy, for a batch of texts at once: a text is a sparse row, the buckets of its n-grams, and
the product adds up their rows of the matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessella.llm.common import bounded_batches, release_memory, sample_by_hash

N = 3
BUCKETS = 1 << 16
#: Labelled documents that training reads, about; a bound, not a share.
SAMPLE = 20_000
#: N-grams that one document adds to the counts, at most (a longer one's counts are scaled down).
WEIGHT = 5_000
#: Characters that a block of a text holds; blocks overlap by N - 1, so no n-gram is lost.
_BLOCK = 1 << 18
#: Entries of the matrix that a step of a batch's product gathers, about.
_GATHER = 1 << 22
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _grams(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For n from 1: n, and the bucket of the n-gram that starts at each place."""
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, min(N, len(codes)) + 1):
        with np.errstate(over="ignore"):
            # h holds the rolling value of the n - 1 characters before
            h = (h[: len(codes) - n + 1] if n > 1 else h) * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield n, (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def buckets(text: str) -> Iterator[np.ndarray]:
    """The bucket of each n-gram of a text, block by block."""
    codes = _codes([text.lower()])
    for at in range(0, len(codes), _BLOCK):
        fresh = at - max(0, at - N + 1)  # n-grams must end in the new part
        for n, found in _grams(codes[at - fresh : at + _BLOCK]):
            yield found[max(0, fresh - n + 1) :]


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    logs: np.ndarray  # buckets x languages

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Each text's likeliest language and its posterior; ties go to the language that sorts first."""
        known = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        out = [(UNKNOWN, 0.0)] * len(texts)
        room = max(1, _GATHER // (N * max(1, len(self.languages))))
        group: list[int] = []
        size = 0
        for i in [*known, -1]:
            if group and (i < 0 or size + len(texts[i]) > room):
                totals = self.prior + self._product([texts[j].lower() for j in group])
                best = totals.argmax(axis=1)
                sure = 1 / np.exp(totals - totals.max(axis=1)[:, None]).sum(axis=1)
                for j, at, p in zip(group, best.tolist(), sure.tolist()):
                    out[j] = self.languages[at], p
                group, size = [], 0
            if i >= 0:
                group.append(i)
                size += len(texts[i])
        return out

    def _product(self, texts: list[str]) -> np.ndarray:
        """Texts (none is empty) as sparse rows, times the matrix."""
        if len(texts) == 1:
            total = np.zeros((1, len(self.languages)))
            for b in buckets(texts[0]):
                counts = np.bincount(b, minlength=1)
                seen = np.flatnonzero(counts)
                total[0] += counts[seen] @ self.logs[seen]
            return total
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate([[0], ends[:-1]])
        total = np.zeros((len(texts), len(self.languages)))
        for n, found in _grams(_codes(texts)):
            last = np.repeat(ends, ends - starts)[: len(found)] - n
            inside = np.arange(len(found)) <= last  # n-grams of one text, not of two
            owner = np.repeat(np.arange(len(texts)), np.maximum(ends - starts - n + 1, 0))
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(owner):
                total[owner[first]] += np.add.reduceat(self.logs[found[inside]], first, axis=0)
        return total

    def score(self, text: str | None) -> tuple[str, float]:
        return self.scores([text])[0]


def fit(docs: DataFrame, chosen: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, smooth: float = 0.1, weight: int = WEIGHT) -> Model:
    """Learns from about ``sample`` of the rows that ``chosen`` picks and whose language is not null.

    Without such rows the model is empty and calls every text unknown. A document adds ``weight`` n-grams at most: a longer
    one's counts are scaled down, so that a few very long ones do not drown the rest. Null texts add nothing but their
    language's share. The matrix takes half a megabyte a language; tasks send their counts on at 64 languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = [np.bincount(b, minlength=BUCKETS) for b in buckets(text.as_py() or "")]
                one = np.sum(grams, axis=0, dtype=np.float64) if grams else np.zeros(BUCKETS)
                mine = sums.setdefault(lang, np.zeros(BUCKETS))
                mine += one * min(1.0, weight / max(1.0, one.sum()))
                docs[lang] = docs.get(lang, 0) + 1
                if len(sums) >= 64:
                    yield from flush(sums, docs)
        yield from flush(sums, docs)

    def flush(sums: dict[str, np.ndarray], docs: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array([*at.tolist(), -1], pa.int32()), pa.array([*v[at].tolist(), float(docs[lang])], pa.float64())], ["lang", "bucket", "n"])
        sums.clear()
        docs.clear()

    known = docs.where(chosen & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    picked = sample_by_hash(known, "__id", sample).select("lang", "text")
    table = bounded_batches(picked).mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum(F.round("n", 6)).alias("n")).toArrow()
    lang, bucket, n = (table.column(i).to_numpy() for i in range(3))
    languages = sorted(set(lang.tolist()))
    if not languages:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0)))
    place = {x: i for i, x in enumerate(languages)}
    column = np.array([place[x] for x in lang.tolist()])
    counts, rows = np.full((BUCKETS, len(languages)), smooth), np.zeros(len(languages))
    grams = bucket >= 0
    counts[bucket[grams], column[grams]] += n[grams]
    rows[column[~grams]] = n[~grams]
    return Model(languages, np.log(rows / rows.sum()), np.log(counts / counts.sum(axis=0)))


def annotate(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "__lang_pred", score_out: str = "__lang_score") -> DataFrame:
    """``docs`` with the columns ``lang_out`` and ``score_out`` for each whole text; rows and other columns stay as they are.

    Null, empty and letterless texts: ``und`` with score 0. Of equally likely languages the one that sorts first. An empty
    table stays empty. A table that has a column of either name already is an error: choose another.
    """
    if {lang_out, score_out} & set(docs.columns):
        raise ValueError(f"the table has a column {lang_out} or {score_out} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, lang_out, score_out]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = m.scores(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names)
        release_memory()

    schema = StructType([*docs.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())])
    return bounded_batches(docs).mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: one row per input row (see ``annotate``). Null and repeated ids have rows like any others.

    Only the two named columns are read, whatever others there are.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return annotate(slim, model).select("doc_id", F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))
