"""Language identification by interpolated Kneser-Ney character models.

For each language, character n-grams up to ``order`` are counted in its learning texts; the highest order uses counts,
lower ones the number of different characters seen before (continuation counts), each discounted by its own D. All
languages share one sorted array of 64-bit n-gram hashes an order, with a row of log probabilities beside each; a
gram no language saw backs off by the context's weight, which has a sorted array of its own. A text goes to the
language of lowest cross-entropy a character. It counts as rejected where that entropy lies further above
what the language's own held-out texts have, given the text's length, than all but a share of ``beyond`` of them would.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches

#: Learning texts a language at most, those first by a hash of their id; whole texts are read.
FIT_DOCS = 800
ORDER = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32
_PIECE = 1 << 20
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool))
    return _LETTER[0]


def characters(text: str | None) -> np.ndarray:
    """Lower-case code points with every run of others than letters as one space; empty if there is no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    keep = is_letter | np.r_[True, is_letter[:-1]]
    return np.where(is_letter, codes, _SPACE)[keep].astype(np.uint32)


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[n][i]: of the n characters that end at i (those before the start count as 0)."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out = [np.zeros(len(codes), np.uint64)]
    for n in range(1, order + 1):
        before = np.r_[np.zeros(1, np.uint64), out[n - 1][:-1]] if n > 1 else out[0]
        out.append((before * _STEP + mixed) ^ np.uint64(n))
    return out


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in the sorted keys; -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _spread(squares: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Least squares of squared deviations on 1 and 1/n, neither coefficient below 0 and the second above."""
    x = np.stack([np.ones(len(n)), 1 / n], axis=1)
    (between, within), *_ = np.linalg.lstsq(x, squares, rcond=None)
    if between < 0 or within <= 0:
        between, within = (0.0, float((squares * n).mean())) if between < 0 else (float(squares.mean()), 0.0)
    return float(between), max(float(within), 1e-6)


class KneserNeyLanguages:
    """fit() on (text, language) pairs; entropies(texts) and predict(texts)."""

    def __init__(self, order: int = ORDER, beyond: float = 0.001):
        self.order, self.beyond = order, beyond
        self.languages: list[str] = []

    def fit(self, rows: list[tuple[str | None, str]]) -> KneserNeyLanguages:
        """A language whose texts have no letter is not learnt."""
        self.languages = sorted({lang for t, lang in rows if len(characters(t))})
        if not self.languages:
            return self
        lanes, count = [], len(self.languages)
        pad = np.full(self.order - 1, _SPACE, np.uint32)
        held: dict[int, list[np.ndarray]] = {}
        for k, lang in enumerate(self.languages):
            texts = [c for c in (characters(t) for t, x in rows if x == lang) if len(c)]
            held[k] = texts[::8] if len(texts) >= 16 else texts  # these calibrate; with few texts all do both
            learn = [c for i, c in enumerate(texts) if i % 8] if len(texts) >= 16 else texts
            codes = np.concatenate([x for c in learn for x in (pad, c)]) if learn else np.empty(0, np.uint32)
            real = np.concatenate([np.r_[np.zeros(len(pad), bool), np.ones(len(c), bool)] for c in learn]) if learn else np.empty(0, bool)
            lanes.append((gram_hashes(codes, self.order), real))

        #: of each order: gram, its ending without the first character, its context without the last
        self.keys, self.logs, self.contexts, self.weights = [np.empty(0, np.uint64)], [np.empty((0, count))], [np.empty(0, np.uint64)], [np.empty((0, count))]
        grams = [None]
        for n in range(1, self.order + 1):
            per = []
            for hashes, real in lanes:
                at = np.flatnonzero(real)
                full, place, times = np.unique(hashes[n][at], return_index=True, return_counts=True)
                first = at[place]
                context = np.where(first > 0, hashes[n - 1][first - 1], np.uint64(0)) if n > 1 else np.zeros(len(first), np.uint64)
                per.append((full, times, hashes[n - 1][first] if n > 1 else np.zeros(len(first), np.uint64), context))
            grams.append(per)
        characters_seen = max(1, len(np.unique(np.concatenate([p[0] for p in grams[1]]))))
        self.unseen = np.full(count, -math.log(characters_seen + 1))
        for n in range(1, self.order + 1):
            keys, place = np.unique(np.concatenate([p[0] for p in grams[n]]), return_index=True)
            endings, contexts = (np.concatenate([p[i] for p in grams[n]])[place] for i in (2, 3))
            ctx_keys = np.unique(contexts)
            probs, weights = np.zeros((len(keys), count)), np.zeros((len(ctx_keys), count))
            lower = self.logs[n - 1][_lookup(self.keys[n - 1], endings)] if n > 1 else np.tile(self.unseen, (len(keys), 1))
            for k in range(count):
                full, times, _, context = grams[n][k]
                if n < self.order:  # how many different characters stand before the gram
                    ends, befores = np.unique(grams[n + 1][k][2], return_counts=True)
                    got = _lookup(ends, full)
                    times = np.where(got >= 0, befores[got], 1)
                ones, twos = int((times == 1).sum()), int((times == 2).sum())
                discount = min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.05), 0.95)
                at = np.searchsorted(ctx_keys, context)
                total, kinds = np.bincount(at, times, len(ctx_keys)), np.bincount(at, minlength=len(ctx_keys))
                weights[:, k] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                probs[np.searchsorted(keys, full), k] = (times - discount) / total[at]
            own = np.searchsorted(ctx_keys, contexts)
            self.keys.append(keys)
            self.logs.append(np.log(probs + weights[own] * np.exp(lower)))
            self.contexts.append(ctx_keys)
            self.weights.append(np.log(weights))
        #: of each language: mean entropy, variance between texts, variance of one character; and the limit in such deviations
        self.normal, excess = np.zeros((count, 3)), []
        for k, texts in held.items():
            e, n = np.array([self._sums([c])[0][0][k] / len(c) for c in texts]), np.array([len(c) for c in texts])
            mean = np.average(e, weights=n)
            self.normal[k] = mean, *_spread((e - mean) ** 2, n)
            excess += ((e - mean) / np.sqrt(self.normal[k, 1] + self.normal[k, 2] / n)).tolist()
        # the held-out texts are few beside what is asked, so the tail beyond them is that of a normal distribution of their spread
        self.limit = max(excess) + NormalDist().inv_cdf(1 - self.beyond) * float(np.std(excess)) if excess else 0.0
        return self

    def _logs_at(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Log probabilities in each language of the characters at the positions, given those before."""
        n = self.order
        got = _lookup(self.keys[n], hashes[n][at])
        out = self.logs[n][got]
        open_ = np.flatnonzero(got < 0)
        back = np.zeros((len(open_), len(self.languages)))
        while len(open_):
            where = at[open_]
            context = np.where(where > 0, hashes[n - 1][where - 1], np.uint64(0)) if n > 1 else np.zeros(len(where), np.uint64)
            c = _lookup(self.contexts[n], context)
            back += np.where((c >= 0)[:, None], self.weights[n][c], 0.0)
            n -= 1
            if n == 0:
                out[open_] = back + self.unseen
                break
            got = _lookup(self.keys[n], hashes[n][where])
            hit = got >= 0
            out[open_[hit]] = back[hit] + self.logs[n][got[hit]]
            open_, back = open_[~hit], back[~hit]
        return out

    def _sums(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Negative log-likelihood of each text in each language, and the texts' lengths."""
        sums, lead = np.zeros((len(docs), len(self.languages))), self.order - 1
        pad = np.full(lead, _SPACE, np.uint32)
        parts: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush():
            codes = np.concatenate([p for _, p in parts])
            lengths = np.array([len(p) for _, p in parts])
            starts = np.cumsum(lengths) - lengths
            at = np.concatenate([np.arange(s + lead, s + n) for s, n in zip(starts, lengths, strict=True)])
            logs = self._logs_at(gram_hashes(codes, self.order), at)
            begin = np.cumsum(lengths - lead) - (lengths - lead)
            np.subtract.at(sums, [d for d, _ in parts], np.add.reduceat(logs, begin, axis=0))
            parts.clear()

        for d, codes in enumerate(docs):
            whole = np.r_[pad, codes] if len(codes) else codes
            for s in range(lead, len(whole), _PIECE):  # a long text goes piece by piece, with what precedes each
                parts.append((d, whole[s - lead : s + _PIECE]))
                size += len(parts[-1][1])
                if size >= _PIECE:
                    flush()
                    size = 0
        if parts:
            flush()
        return sums, np.array([len(c) for c in docs])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, entropy a character, rejected) of each text; 'und', 0, None, True without a letter."""
        if not self.languages:
            return [("und", 0.0, None, True)] * len(texts)
        sums, lengths = self._sums([characters(t) for t in texts])
        out = []
        for total, n in zip(sums, lengths.tolist(), strict=True):
            if not n:
                out.append(("und", 0.0, None, True))
                continue
            e = total / n
            best = int(np.argmin(e))
            odds = np.exp(-(e - e[best]) * min(n, 50))
            mean, between, within = self.normal[best]
            out.append((self.languages[best], float(1 / odds.sum()), float(e[best]), bool(e[best] > mean + self.limit * math.sqrt(between + within / n))))
        return out


def fit_languages(df: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, **params) -> KneserNeyLanguages:
    """Models from at most fit_docs whole texts a language, null languages and texts left out. Of rows that repeat an id in a
    language, the least text counts."""
    rows = (df if where is None else df.where(where)).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("l is not null")
    ids = rows.select("i", "l").distinct().withColumn("h", F.xxhash64("i", F.lit(29)))
    chosen = []  # ids only, so that texts neither move nor reach the driver before they are chosen
    for lang in sorted(r.l for r in ids.select("l").distinct().collect()):
        chosen += [(r.i, lang) for r in ids.where(F.col("l") == lang).orderBy("h", "i").limit(fit_docs).collect()]
    picked = F.broadcast(df.sparkSession.createDataFrame(chosen, "pi long, pl string"))  # fit_docs rows a language at most
    got = rows.join(picked, F.col("i").eqNullSafe(F.col("pi")) & (F.col("l") == F.col("pl")), "inner").where("t is not null").groupBy("i", "l").agg(F.min("t").alias("t")).collect()
    return KneserNeyLanguages(**params).fit([(r.t, r.l) for r in sorted(got, key=lambda r: (r.l, -1 if r.i is None else r.i, r.t))])


def language_frames(model):
    """For mapInArrow over (id, text): (id, lang_pred, score, entropy, rejected)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*model.value.predict(b.column(1).to_pylist()), strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], ["id", "lang_pred", "score", "entropy", "rejected"])

    return run


def identify(df: DataFrame, model: KneserNeyLanguages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, lang_pred, score, entropy, rejected). Null texts and texts without a letter are
    'und' with score 0. What all tasks get is the models, at most one gram an order and learning character."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(language_frames(held), "id long, lang_pred string, score double, entropy double, rejected boolean").withColumnRenamed("id", id_col)
