"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into a bin. Boosting goes round the features in turn and fits each a shallow tree on the
bins' gradients, so every feature ends with a lookup table; then the pairs with the strongest joint residual get tables
over two features in the same way. A score is a sum of table entries, looked up for all rows of a batch at once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, if_small, sample_by_hash, written

#: Labelled rows that training gathers, about; a bound, not a share.
SAMPLE = 20_000
THRESHOLD = 0.3
_SENTENCE_END = re.compile(r"[.!?][\"')\]]*\s")

FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_length", "longest_word", "upper", "digit", "space", "newline", "non_ascii",
    "letters", "period", "comma", "exclamation", "question", "pipe", "symbols", "brackets", "other_marks", "control",
    "distinct_words", "distinct_pairs", "top_word", "short_words", "capital_words", "marked_words", "distinct_lines",
    "line_words", "sentence_words", "squeezed", "entropy", "triple_share", "ended_lines", "vowels",
)


def features(text: str | None) -> list[float]:
    """The numbers that describe a whole text; of null and empty texts all are zero."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total = len(raw)
    share = lambda chars: sum(int(seen[c]) for c in chars) / total
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = set(words)
    pairs = set(zip(words, words[1:]))
    triples = set(zip(words, words[1:], words[2:]))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    p = seen[seen > 0] / total
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    return [
        np.log1p(total), np.log1p(len(words)), np.log1p(len(lines)), float(lengths.mean()), np.log1p(int(lengths.max())),
        upper / max(1, upper + lower), seen[48:58].sum() / total, share(b" "), share(b"\n"), seen[128:].sum() / total,
        (upper + lower) / total, share(b"."), share(b","), share(b"!"), share(b"?"), share(b"|"), share(b"#$%&*@~^_+=<>\\"), share(b"()[]{}"), share(b"-'\":;/`"), (seen[:9].sum() + seen[14:32].sum()) / total,
        len(distinct) / n, len(pairs) / max(1, len(words) - 1), max(counts.values(), default=0) / n, float((lengths <= 3).sum()) / n, sum(map(str.isupper, map(first, words))) / n, sum(not w[-1].isalnum() for w in words) / n, len(set(lines)) / m,
        n / m, np.log1p(n / (1 + len(_SENTENCE_END.findall(text)))), len(zlib.compress(raw, 1)) / total, float(-(p * np.log2(p)).sum()), len(triples) / max(1, len(words) - 2), sum(x.rstrip()[-1:] in ".!?" for x in lines) / m, share(b"aeiou") * total / max(1, lower),
    ]


def first(word: str) -> str:
    return word[0]


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # fine bin -> coarse bin, by feature
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            out += t[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        return 1 / (1 + np.exp(-self.margin(self.bins(x))))


def _gain(g: np.ndarray, h: np.ndarray, reg: float) -> np.ndarray:
    return g * g / (h + reg)


def _split(g: np.ndarray, h: np.ndarray, reg: float, least: float) -> tuple[float, int]:
    """The best cut of a run of bins: gain, and number of bins left of it (0: none)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), _gain(gl, hl, reg) + _gain(gr, hr, reg) - _gain(g.sum(), h.sum(), reg), 0.0)
    at = int(np.argmax(gain))
    return float(gain[at]), (at + 1 if gain[at] > 1e-9 else 0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, reg: float, least: float) -> np.ndarray:
    """Leaf values by bin, of a tree grown best-first over the bins' sums of gradients and curvatures."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cut = [(*_split(g[a:b], h[a:b], reg, least), a, b) for a, b in parts]
        gain, at, a, b = max(cut)
        if not at:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + reg)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, reg: float, least: float) -> np.ndarray:
    """The same over a grid: one cut along an axis, then one along the other in each part."""
    best: tuple[float, np.ndarray] = (-1.0, np.zeros(g.shape))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(gg)):
            out, gain = np.zeros(gg.shape), 0.0
            for part in (slice(0, at), slice(at, None)):
                ga, ha = gg[part].sum(axis=0), hh[part].sum(axis=0)
                got, cut = _split(ga, ha, reg, least)
                gain += got + _gain(ga.sum(), ha.sum(), reg)
                for side in (slice(0, cut), slice(cut, None)):
                    out[part, side] = ga[side].sum() / (ha[side].sum() + reg)
            if gain > best[0]:
                best = gain, out.T if turned else out
    return best[1]


def train(x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, grid: int = 8, rate: float = 0.1, leaves: int = 3, reg: float = 1.0, least: float = 2.0) -> Model:
    """Fits by cyclic boosting on the log loss. With one class (or no rows) the score is the same for all."""
    model = Model()
    y = np.asarray(y, float)
    rate_of_ones = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if len(set(y.tolist())) < 2:
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    bins = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, size in enumerate(sizes):
            if size < 2:
                continue
            p = 1 / (1 + np.exp(-margin))
            step = rate * _tree(np.bincount(bins[:, j], y - p, size), np.bincount(bins[:, j], p * (1 - p), size), leaves, reg, least)
            model.tables[j] += step
            margin += step[bins[:, j]]
    strength = [float(np.abs(t[bins[:, j]]).mean()) for j, t in enumerate(model.tables)]
    model.coarse = [np.arange(s) * min(grid, s) // s for s in sizes]
    rough = [min(grid, s) for s in sizes]
    cell = lambda a, b: model.coarse[a][bins[:, a]] * rough[b] + model.coarse[b][bins[:, b]]
    sums = lambda at, v, a, b: np.bincount(at, v, rough[a] * rough[b]).reshape(rough[a], rough[b])
    p = 1 / (1 + np.exp(-margin))
    ranked = []
    for a, b in combinations(sorted(np.argsort(strength)[::-1][:10].tolist()), 2):
        at = cell(a, b)
        g, h = sums(at, y - p, a, b), sums(at, p * (1 - p), a, b)
        ranked.append((float((_tree2(g, h, reg, least) * g).sum()), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(ranked, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((rough[a], rough[b])) for a, b in model.pairs]
    cells = [cell(a, b) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for i, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-margin))
            step = rate * _tree2(sums(cells[i], y - p, a, b), sums(cells[i], p * (1 - p), a, b), reg, least)
            model.pair_tables[i] += step
            margin += step.ravel()[cells[i]]
    return model


def _measured(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The columns of ``keep`` and the features as one array."""
    slim = bounded_batches(docs).select(*keep, F.col(text_col).cast("string").alias("__text"))
    names = [*keep, "__x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(x, pa.list_(pa.float64()))], names)

    kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(run, f"{kinds}, __x array<double>")


def fit(docs: DataFrame, labels: DataFrame, chosen: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from about ``sample`` of the labelled rows that ``chosen`` (over the labels) picks; null labels are left out.

    Of labels that repeat an id, the largest counts, so the sample's ids are distinct and bounded: they may be broadcast if
    they are counted to be few, and the features gathered on the driver (of documents that repeat an id, one by the least
    features). A label of 1 or more counts as one. Training rows are sorted, so that it gives the same model whatever order they come in.
    """
    known = labels.where(chosen & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) >= 1).cast("int").alias("__y"))
    picked = written(sample_by_hash(known.groupBy("__id").agg(F.max("__y").alias("__y")), "__id", sample), "quality-sample")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(if_small(picked), "__id")
    measured = _measured(rows.select("__id", "__y", "__t"), ["__id", "__y"], "__t")
    got = measured.groupBy("__id").agg(F.min(F.struct("__y", "__x")).alias("r")).select("r.*").toArrow()
    y = got.column("__y").to_numpy()
    x = np.array(got.column("__x").to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))
    return train(x[order], y[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every whole text (null: empty): one row per input row, repeated rows and null ids too.

    Equal texts have equal scores. An empty table gives no rows. Only the id and text columns are read, whatever others
    there are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)], float).reshape(-1, len(FEATURES))
            s = m.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    slim = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    return slim.mapInArrow(run, "doc_id long, score double, predicted int")
