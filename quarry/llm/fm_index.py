"""Benchmark decontamination with an FM-index over each shard of the training text.

A shard is a run of documents inside a task. Its words are numbered by the vocabulary of the benchmark block in hand;
a stretch without an unbroken run of benchmark words as long as the shortest window cannot hold a window, so the
index covers the other stretches only, each closed by a separator. The index is a Burrows-Wheeler transform
with wavelet ranks; windows are found by backward search, all at once, and their places by walking to
sampled suffix positions (each stretch's start is sampled, so no walk crosses a separator). Places become
spans of words to remove, merged where they overlap or touch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, small_batches, with_row_key, without_rows

WINDOW = 10
#: Benchmark text sent to all tasks at once, in characters; a larger benchmark is taken in blocks of about this size.
BLOCK_CHARS = 16_000_000
#: Documents are indexed together until the shard has so many positions.
SHARD_POSITIONS = 1 << 20
SAMPLE = 8

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text: A-Z lower-cased, then runs of digits, letters and all beyond ASCII."""
    return _WORD.findall(text.encode().lower()) if text else []


class Phrases:
    """The windows of one block of benchmark items, numbered, with the items each belongs to."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.items = sorted({str(i) for i, _ in items if i is not None})
        number = {i: n for n, i in enumerate(self.items)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + window]), set()).update([] if item is None else [number[str(item)]])
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.shortest = int(self.lengths.min()) if owners else 0
        self.codes = np.zeros((len(owners), window), np.int64)  # right-aligned, 0 before a shorter phrase
        for n, w in enumerate(owners):
            self.codes[n, window - len(w) :] = w
        counts = [len(o) for o in owners.values()]
        self.owner_at = np.r_[0, np.cumsum(counts)].astype(np.int64)
        self.owner = np.array([x for o in owners.values() for x in sorted(o)], np.int64)


class WaveletRanks:
    """Rank queries over a sequence of symbols below 2**levels, by one bit plane a level."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.planes, self.zeros = [], []
        for k in range(levels - 1, -1, -1):
            bit = (seq >> k) & 1
            self.planes.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(seq) - self.planes[-1][-1]))
            seq = np.r_[seq[bit == 0], seq[bit == 1]]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi, last = np.zeros_like(at), at.copy(), len(self.planes) - 1
        for level, (ones, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            one = (symbol >> (last - level)) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """The suffix array of stretches closed by separators (0), which rank below all and differ from each other."""
    n, seps = len(seq), int((seq == 0).sum())
    rank = np.where(seq == 0, np.cumsum(seq == 0) - 1, seq + seps).astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    rank[order] = np.cumsum(np.r_[0, np.diff(rank[order]) != 0])
    loose = np.arange(n)
    while True:
        # only suffixes that still share their rank are compared on; a rank is the place of its group's first suffix
        sorted_rank = rank[order]
        first = np.r_[True, np.diff(sorted_rank) != 0]
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[order] = start
        tied = ~first
        tied[:-1] |= ~first[1:]
        loose = order[tied]
        if not len(loose):
            return order
        after = np.minimum(loose + step, n - 1)
        sub = np.argsort(rank[loose] * (n + 1) + rank[after], kind="stable")
        moved, key = loose[sub], (rank[loose] * (n + 1) + rank[after])[sub]
        slots = np.flatnonzero(tied)
        order[slots] = moved
        change = np.r_[True, np.diff(key) != 0]
        rank[moved] = slots[np.maximum.accumulate(np.where(change, np.arange(len(slots)), 0))]
        step *= 2


class FMIndex:
    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        """seq: stretches of positive symbols, each closed by 0."""
        self.size = len(seq)
        order = suffix_order(seq)
        before = seq[order - 1]
        before[order == 0] = 0
        self.bwt = before
        self.below = np.r_[0, np.cumsum(np.bincount(seq, minlength=int(seq.max()) + 1))].astype(np.int64)
        self.top = len(self.below) - 1
        self.ranks = WaveletRanks(before, max(1, int(seq.max()).bit_length()))
        self.marked = (order % sample == 0) | (before == 0)
        self.mark_rank = np.r_[0, np.cumsum(self.marked)].astype(np.int64)
        self.samples = order[self.marked]

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each right-aligned phrase."""
        lo, hi = np.zeros(len(codes), np.int64), np.full(len(codes), self.size, np.int64)
        for k in range(codes.shape[1] - 1, -1, -1):
            live = np.flatnonzero((codes[:, k] > 0) & (hi > lo))
            c = codes[live, k]
            known = c < self.top
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            if not len(live):
                continue
            base = self.below[c]
            lo[live], hi[live] = base + self.ranks.rank(c, lo[live]), base + self.ranks.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by stepping back to the nearest sampled one."""
        out, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            at = self.marked[rows[open_]]
            got = open_[at]
            out[got] = self.samples[self.mark_rank[rows[got]]] + steps
            open_ = open_[~at]
            c = self.bwt[rows[open_]]
            rows[open_] = self.below[c] + self.ranks.rank(c, rows[open_])
            steps += 1
        return out


def scan_shard(phrases: Phrases, docs: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """For each document of a shard, as codes of its words (0: not in the vocabulary): spans [start, end) and item ids."""
    seqs, doc_of, word_of = [], [], []
    for d, codes in enumerate(docs):
        edge = np.diff(np.r_[0, (codes > 0).view(np.int8), 0])
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = ends - starts >= phrases.shortest
        for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            seqs += [codes[s:e], np.zeros(1, codes.dtype)]
            doc_of.append((d, e - s + 1))
            word_of.append(np.arange(s, e + 1))
    out: list = [([], []) for _ in docs]
    if not seqs or not len(phrases.codes):
        return out
    seq, word = np.concatenate(seqs).astype(np.int64), np.concatenate(word_of)
    doc = np.repeat([d for d, _ in doc_of], [n for _, n in doc_of])
    index = FMIndex(seq)
    lo, hi = index.search(phrases.codes)
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    if not len(which):
        return out
    at = index.locate(np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(which)))
    cover = np.cumsum(np.bincount(at, minlength=len(seq) + 1) - np.bincount(at + phrases.lengths[which], minlength=len(seq) + 1)[: len(seq) + 1]) > 0
    edge = np.diff(np.r_[0, cover.view(np.int8), 0])
    for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        spans = out[doc[s]][0]  # a span ends before its stretch's separator at the latest
        spans.append((int(word[s]), int(word[e - 1]) + 1))
    per = np.diff(phrases.owner_at)[which]
    own = phrases.owner[np.repeat(phrases.owner_at[which] - np.r_[0, np.cumsum(per)[:-1]], per) + np.arange(per.sum())]
    pairs = np.unique(np.repeat(doc[at], per) * len(phrases.items) + own)
    for p in pairs.tolist():
        out[p // len(phrases.items)][1].append(phrases.items[p % len(phrases.items)])
    return out


def scan_frames(phrases, shard_positions: int = SHARD_POSITIONS):
    """For mapInArrow over (key, text): (key, n_words, spans, items), key being whatever the first column holds."""
    import pyarrow as pa

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def flush(keys, held):
        found = scan_shard(phrases.value, held)
        cols = [
            pa.concat_arrays(keys),
            pa.array([len(h) for h in held], pa.int64()),
            pa.array([[{"start": s, "end": e} for s, e in f[0]] for f in found], span),
            pa.array([f[1] for f in found], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(cols, ["key", "n_words", "spans", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = phrases.value.vocab
        keys, held, size = [], [], 0
        for b in batches:
            for at, text in enumerate(b.column(1)):
                words = words_of(text.as_py())
                keys.append(b.column(0).slice(at, 1))
                held.append(np.fromiter((vocab.get(w, 0) for w in words), np.int32, len(words)))
                size += len(words)
                if size >= shard_positions or len(held) >= 20_000:
                    yield flush(keys, held)
                    keys, held, size = [], [], 0
        if held:
            yield flush(keys, held)

    return run


def _merged(spans):
    """Column: ranges in ascending order, those that overlap or touch as one."""
    none = F.expr("cast(array() as array<struct<start:long,end:long>>)")
    wider = lambda done, s: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))
    meets = lambda done, s: (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"])
    return F.aggregate(F.sort_array(spans), none, lambda done, s: F.when(meets(done, s), wider(done, s)).otherwise(F.concat(done, F.array(s))))


def _scan(rows: DataFrame, key_type: str, items: DataFrame, blocks: int, window: int) -> list[DataFrame]:
    """Of rows (key, text) and each block of items: (key, n_words, spans, items). One block is a plan; of several, each is
    run and written before the next one's phrases are sent, so that no task holds two; after the first only rows with hits."""
    spark, out = rows.sparkSession, []
    small_batches(spark)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in part.collect()], window))  # about block_chars characters
        found = rows.mapInArrow(scan_frames(held), f"key {key_type}, n_words long, spans array<struct<start:long,end:long>>, items array<string>")
        if blocks > 1:
            found = materialize(found if k == 0 else found.where("size(spans) > 0"), "block-hits")
            held.unpersist()
        out.append(found)
    return out


def _items(benchmark: DataFrame, item_col: str, item_text: str, block_chars: int) -> tuple[DataFrame, int]:
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text].cast("string").alias("text"))
    return items, max(1, -(-(items.agg(F.sum(F.length("text") + 16)).first()[0] or 0) // block_chars))


def _hits(found: list[DataFrame]) -> DataFrame:
    """(key, n_words, spans, items) of the rows that any block hits, over all blocks."""
    hits = found[0].where("size(spans) > 0")
    if len(found) == 1:
        return hits
    for more in found[1:]:
        hits = hits.unionByName(more)
    return hits.groupBy("key").agg(
        F.first("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: (id, n_words, spans array of word ranges to remove, items array of matched item ids).

    An item of fewer words than a window is one window; an item without words, or null, matches nothing.
    Documents without words have 0 words and no spans. Item ids are compared as strings; rows that repeat an
    item add their windows to it; an item without an id has spans but is not listed. Only (id, text) of either table are
    read. The benchmark is taken in blocks of about block_chars characters, one after another.
    """
    items, blocks = _items(benchmark, item_col, item_text, block_chars)
    if blocks == 1:
        rows = df.select(df[id_col].cast("long").alias("key"), df[text_col].cast("string").alias("text"))
        return _scan(rows, "long", items, 1, window)[0].withColumnRenamed("key", id_col)
    keyed, key = with_row_key(df)
    rows = keyed.select(F.struct(F.col(id_col).cast("long").alias("id"), F.col(key).alias("row")).alias("key"), F.col(text_col).cast("string").alias("text"))
    found = _scan(rows, "struct<id:long,row:struct<file:long,at:long>>", items, blocks, window)
    told = _hits(found).select(F.col("key.row").alias("_at"), F.col("spans").alias("_spans"), F.col("items").alias("_items"))
    whole = found[0].join(told, found[0]["key.row"] == told["_at"], "left")
    return whole.select(F.col("key.id").alias(id_col), "n_words", F.coalesce("_spans", "spans").alias("spans"), F.coalesce("_items", "items").alias("items"))


def word_spans_to_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without what stands between those words."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.lower())]
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.0, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """df without the rows of which more than ``share`` of the words are hit, whatever their ids; all columns as they were."""
    keyed, key = with_row_key(df)
    rows = keyed.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"))
    items, blocks = _items(benchmark, item_col, item_text, block_chars)
    hits = _hits(_scan(rows, "struct<file:long,at:long>", items, blocks, window))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return without_rows(keyed, hits.where(hit > share * F.col("n_words")).select("key"), key)
