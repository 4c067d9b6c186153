"""Toxicity by compression distance to two zstandard dictionaries.

One dictionary is trained on ordinary text, one on toxic text. A window of a text (``window_words`` words, set in a
fixed frame so that the few bytes of a window aren't drowned in block headers) is compressed with each; the pair
of compressed lengths, with the window's own length, is its cell. A second part of the labelled rows says how much
likelier each cell is in toxic texts than in ordinary ones (its threshold table), and the likeliest cells of a
text, through a logistic curve fitted on the same part with the text's own counts left out, give its score.

Toxic rows are mostly ordinary text. Their dictionary is therefore trained on windows around the words that
toxic rows hold far more often than chance, by a binomial deviation of at least ``contrast``.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keep_frames, small_batches

#: Rows of each label that a fit reads at most, those first by a hash of their id. Their whole texts are read.
FIT_TOXIC, FIT_ORDINARY = 2000, 4000
DICTIONARY_BYTES = 16384
LONG_CELLS = 32
_FRAME = b" the text of this very window reads "
_TOKEN = re.compile(rb"[0-9a-z'\x80-\xff]+")


def tokens(text: str | None) -> list[bytes]:
    return _TOKEN.findall(text.encode().lower()) if text else []


class CompressionClassifier:
    """fit() on (text, label) pairs, then score(text) in 0..1. Without rows of both labels the score is the share of
    label 1 for every text; without rows it is 0."""

    def __init__(self, window_words: int = 1, dictionary_bytes: int = DICTIONARY_BYTES, contrast: float = 4.5, level: int = 19, cache_windows: int = 250_000):
        self.window_words, self.dictionary_bytes, self.contrast, self.level, self.cache_windows = window_words, dictionary_bytes, contrast, level, cache_windows
        self.dictionaries: list[tuple[bytes, bool]] = []
        self.weights: dict[tuple[int, int, int], float] = {}
        self.beta, self.base = np.zeros(6), 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_compressors", "_known", "_cells")}

    def windows(self, text: str | None) -> set[bytes]:
        words, n = tokens(text), self.window_words
        return set(words) if n == 1 else {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()

    def _train(self, samples: list[bytes]) -> tuple[bytes, bool]:
        """A dictionary's bytes, and whether zstandard could train it; too few samples serve as they are."""
        import zstandard

        try:
            return zstandard.train_dictionary(self.dictionary_bytes, samples, level=self.level).as_bytes(), True
        except zstandard.ZstdError:
            return (b" ".join(samples)[-self.dictionary_bytes :] + _FRAME + _FRAME), False

    def _lengths(self, window: bytes) -> tuple[int, int, int]:
        import zstandard

        if "_compressors" not in self.__dict__:
            self._compressors = []
            for raw, trained in self.dictionaries:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
                p = zstandard.ZstdCompressionParameters.from_level(self.level, dict_size=len(raw), source_size=64, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
        framed = _FRAME + window + _FRAME
        return (min(len(window), 16), *(len(c.compress(framed)) for c in self._compressors))

    def cells(self, text: str | None) -> set[tuple[int, int, int]]:
        known, cells = self.__dict__.setdefault("_known", {}), self.__dict__.setdefault("_cells", {})
        out = set()
        for w in self.windows(text):
            cell = known.get(w)
            if cell is None:
                if len(known) >= self.cache_windows:
                    known.clear()
                cell = self._lengths(w)
                cell = known[w] = cells.setdefault(cell, cell)  # a few hundred different ones
            out.add(cell)
        return out

    @staticmethod
    def _features(weights: list[float]) -> np.ndarray:
        """Of a text's cells: the likeliest, the three likeliest, all likely ones, and how far the text exceeds the length (in cells) at which
        likely cells begin to turn up by chance."""
        top, strong = sorted(weights, reverse=True)[:3] + [0.0] * 3, [w for w in weights if w > 1]
        return np.array([1.0, top[0], sum(top[:3]), sum(strong), max(math.log(max(len(weights), 1) / LONG_CELLS), 0.0), len(strong)])

    def _weight(self, toxic: float, ordinary: float, n_toxic: int, n_ordinary: int, prior: float = 3.0) -> float:
        p = (toxic + ordinary + 0.5) / (n_toxic + n_ordinary + 1)
        return math.log((toxic + prior * p) / (n_toxic + prior)) - math.log((ordinary + prior * p) / (n_ordinary + prior))

    def fit(self, rows: list[tuple[str | None, int]], seed: int = 5) -> CompressionClassifier:
        rng, rows = random.Random(seed), list(rows)
        self.base = sum(y for _, y in rows) / len(rows) if rows else 0.0
        rng.shuffle(rows)
        by = {y: [r for r in rows if r[1] == y] for y in (0, 1)}
        if min(map(len, by.values())) < 4:
            return self
        first = [r for y in by for r in by[y][::2]]
        second = [r for y in by for r in by[y][1::2]]

        seen = {0: Counter(), 1: Counter()}
        for text, y in first:
            seen[y].update(set(tokens(text)))
        share = sum(y for _, y in first) / len(first)
        telling = set()
        for w, a in seen[1].items():
            n = a + seen[0][w]
            if a >= 3 and (a - n * share) / math.sqrt(n * share * (1 - share)) > self.contrast:
                telling.add(w)
        ordinary = [w for t, y in first if not y for w in tokens(t)]
        toxic = [w for t, y in first if y for w in tokens(t) if w in telling] or [w for t, y in first if y for w in tokens(t)]
        frame = lambda words: [_FRAME + b" ".join(words[i : i + 6]) + _FRAME for i in range(0, len(words), 6)]
        plain = frame(ordinary)
        rng.shuffle(plain)
        pointed: list[bytes] = []
        while toxic and len(pointed) < 8000:  # repeated in other orders, so that the words and not their order are learnt
            rng.shuffle(toxic)
            pointed += frame(toxic)
        self.dictionaries = [self._train(plain[:60_000]), self._train(pointed[:60_000])]

        cells = [(self.cells(t), y) for t, y in second]
        total = {y: sum(1 for _, z in cells if z == y) for y in (0, 1)}
        count = {0: Counter(), 1: Counter()}
        for c, y in cells:
            count[y].update(c)
        self.weights = {c: self._weight(count[1][c], count[0][c], total[1], total[0]) for c in {*count[0], *count[1]}}
        x = np.array([self._features([self._weight(count[1][c] - y, count[0][c] - 1 + y, total[1] - y, total[0] - 1 + y) for c in own]) for own, y in cells])
        self.beta = _logistic(x, np.array([y for _, y in cells], float))
        return self

    def score(self, text: str | None) -> float:
        if not self.dictionaries:
            return self.base
        get = self.weights.get
        z = float(self._features([get(c, 0.0) for c in self.cells(text)]) @ self.beta)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_toxicity(df: DataFrame, labels: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_toxic: int = FIT_TOXIC, fit_ordinary: int = FIT_ORDINARY, **params) -> CompressionClassifier:
    """A classifier from at most fit_toxic and fit_ordinary labelled rows (whole texts). Rows without a label are not
    read; an id labelled twice is toxic if any label says so, and of rows that repeat an id the least text counts. where: a
    condition on df's columns."""
    known = labels.where(labels[label_col].isNotNull()).groupBy(labels[id_col].cast("long").alias("_id")).agg(F.max(labels[label_col].cast("int")).alias("_y"))
    rows = (df if where is None else df.where(where)).select(F.col(id_col).cast("long").alias("_i"), F.col(text_col).cast("string").alias("_t"))
    ids = rows.select("_i").distinct().join(known, F.col("_i") == known["_id"], "inner").select("_i", "_y", F.xxhash64("_i", F.lit(17)).alias("_h"))
    chosen = []  # ids only, so that texts neither move nor reach the driver before they are chosen
    for y, most in ((0, fit_ordinary), (1, fit_toxic)):
        chosen += [(r["_i"], y) for r in ids.where(F.col("_y") == y).orderBy("_h", "_i").limit(most).select("_i").collect()]
    picked = F.broadcast(df.sparkSession.createDataFrame(chosen, "_id long, _y int"))  # fit_toxic + fit_ordinary rows at most
    got = rows.join(picked, rows["_i"] == picked["_id"], "inner").groupBy("_i", "_y").agg(F.min("_t").alias("_t")).collect()
    return CompressionClassifier(**params).fit([(r["_t"], r["_y"]) for r in sorted(got, key=lambda r: r["_i"])])


def score_frames(model):
    """For mapInArrow over (id, text): (id, score)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t.as_py()) for t in b.column(1)], pa.float64())], ["id", "score"])

    return run


def toxicity_scores(df: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, score). Null and empty texts have no windows and get the score of none."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a table of cells: a few hundred kB whatever the input
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(score_frames(held), "id long, score double").withColumnRenamed("id", id_col)


def drop_toxic(df: DataFrame, model: CompressionClassifier, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """df without the rows that score at least threshold; the others stay as they were, and where they were."""
    small_batches(df.sparkSession)
    held, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)
    return df.mapInArrow(keep_frames(lambda b: [held.value.score(t.as_py()) < threshold for t in b.column(at)]), df.schema)
