"""Token-id files: canonical, length-limited Huffman codes with checkpoints.

A file set is one code book and many shards, each shard a byte image that decodes alone with the book:

    book:  "QHB1" | u32 symbols | symbols u32[] ascending | code lengths u8[]
    shard: "QHF1" | u32 docs | u32 blocks | u32 block_ids | u64 ids | u64 first
           doc ids i64[docs] | ids per doc u64[docs]
           bit offset of each block u64[blocks]        <- checkpoints: any block decodes alone
           payload, most significant bit first, padded by 8 zero bytes

Shards lie in ascending document order; first is a shard's place among the ids of its part, and the parts' sizes give
each part's place. Lengths follow from the counts of *all* ids of the corpus by the package-merge method, at
most max_bits; codes are canonical (ascending by length, then symbol), so lengths alone restore them.
Decoding looks max_bits up in one table, for all blocks of a shard in step.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.common import discard, materialize, shared_dir, small_batches
from quarry.llm.pretokens import StretchCache, VocabularySpec, library_words

MAX_BITS = 18
BLOCK_IDS = 1024
SHARD_IDS = 1 << 19
#: How a missing document id stands in a shard; it sorts before all others, as null does.
NO_ID = -(1 << 63)
_BOOK = struct.Struct("<4sI")
_SHARD = struct.Struct("<4sIIIQQ")


def limited_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most max_bits (package-merge). A single symbol gets one bit.

    max_bits is raised to what the number of symbols needs.
    """
    symbols = sorted(counts)
    if len(symbols) < 2:
        return dict.fromkeys(symbols, 1)
    max_bits = max(max_bits, (len(symbols) - 1).bit_length())
    weights = np.array([counts[s] for s in symbols], np.float64)
    order = np.argsort(weights, kind="stable")
    base = weights[order]
    levels: list[np.ndarray] = []  # for each level, which places of the merged list are leaves
    packages = np.empty(0)
    for _ in range(max_bits):
        merged = np.concatenate([base, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < len(base))
        merged = merged[place]
        pairs = len(merged) // 2
        packages = merged[0 : 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
    lengths, take = np.zeros(len(base), np.int64), 2 * len(base) - 2
    for leaves in reversed(levels):  # of the first `take` items, leaves count once more, packages open two items below
        n = int(leaves[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    return {symbols[o]: int(n) for o, n in zip(order.tolist(), lengths.tolist(), strict=True)}


class CodeBook:
    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        """symbols ascending."""
        self.symbols, self.lengths = symbols.astype(np.uint32), lengths.astype(np.uint8)
        order = np.lexsort((self.symbols, self.lengths))
        sorted_len = self.lengths[order].astype(np.int64)
        self.max_bits = int(sorted_len[-1]) if len(order) else 1
        spans = np.int64(1) << (self.max_bits - sorted_len)  # a code of n bits owns 2**(max-n) entries of the table
        first = np.r_[0, np.cumsum(spans)[:-1]] if len(order) else np.empty(0, np.int64)
        self.codes = np.zeros(len(order), np.uint64)
        self.codes[order] = (first >> (self.max_bits - sorted_len)).astype(np.uint64)
        self.table = np.zeros(1 << self.max_bits, np.int64)  # entry: place of the symbol
        self.table[: int(spans.sum())] = np.repeat(order, spans)

    @classmethod
    def of(cls, counts: dict[int, int], max_bits: int = MAX_BITS) -> CodeBook:
        lengths = limited_lengths(counts, max_bits)
        symbols = sorted(lengths)
        return cls(np.array(symbols, np.uint32), np.array([lengths[s] for s in symbols], np.uint8))

    def to_bytes(self) -> bytes:
        return _BOOK.pack(b"QHB1", len(self.symbols)) + self.symbols.astype("<u4").tobytes() + self.lengths.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CodeBook:
        magic, n = _BOOK.unpack_from(raw)
        if magic != b"QHB1":
            raise ValueError("not a code book")
        return cls(np.frombuffer(raw, "<u4", n, _BOOK.size), np.frombuffer(raw, "u1", n, _BOOK.size + 4 * n))

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids' codes in a row, most significant bit first, and where each starts."""
        if "_place" not in self.__dict__:
            self._place = np.zeros(int(self.symbols[-1]) + 1, np.int64)
            self._place[self.symbols] = np.arange(len(self.symbols))
        place = self._place[ids]
        n, code = self.lengths[place].astype(np.int64), self.codes[place]
        ends = np.cumsum(n)
        starts = ends - n
        total = int(ends[-1]) if len(ids) else 0
        words = np.zeros((total >> 6) + 2, np.uint64)
        if len(ids):
            word, room = starts >> 6, 64 - (starts & 63)  # room: bits from the code's start to its word's end
            spill = np.maximum(n - room, 0)  # bits that go on in the next word
            lead = (code >> spill.astype(np.uint64)) << np.maximum(room - n, 0).astype(np.uint64)
            cuts = np.flatnonzero(np.r_[True, np.diff(word) != 0])
            words[word[cuts]] = np.bitwise_or.reduceat(lead, cuts)
            over = np.flatnonzero(spill)
            words[word[over] + 1] |= code[over] << (64 - spill[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (total + 7) // 8] + bytes(8), starts


def shard_image(book: CodeBook, doc_ids: list[int], counts: list[int], ids: np.ndarray, first: int, block_ids: int = BLOCK_IDS) -> bytes:
    payload, starts = book.pack(ids)
    blocks = -(-len(ids) // block_ids)
    head = _SHARD.pack(b"QHF1", len(doc_ids), blocks, block_ids, len(ids), first)
    return head + np.array(doc_ids, "<i8").tobytes() + np.array(counts, "<u8").tobytes() + starts[::block_ids].astype("<u8").tobytes() + payload


class ShardReader:
    """Reads a shard image: all ids, or those of some blocks only."""

    def __init__(self, image: bytes, book: CodeBook):
        magic, docs, self.blocks, self.block_ids, self.size, self.first = _SHARD.unpack_from(image)
        if magic != b"QHF1":
            raise ValueError("not a token-id shard")
        at = _SHARD.size
        self.doc_ids = np.frombuffer(image, "<i8", docs, at)
        self.counts = np.frombuffer(image, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(image, "<u8", self.blocks, at + 16 * docs).astype(np.int64)
        self.payload = np.frombuffer(image, "u1", offset=at + 16 * docs + 8 * self.blocks)
        self.book = book

    def decode(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids of blocks lo .. hi-1, each from its checkpoint, all of them in step."""
        hi = self.blocks if hi is None else min(hi, self.blocks)
        count = min(self.size, hi * self.block_ids) - lo * self.block_ids
        if count <= 0:
            return np.empty(0, np.uint32)
        live, tail = hi - lo, count - (hi - lo - 1) * self.block_ids
        out = np.zeros((self.block_ids, live), np.uint32)
        begin = int(self.offsets[lo]) >> 3
        end = len(self.payload) if hi == self.blocks else (int(self.offsets[hi]) >> 3) + 8
        at, p, bits = self.offsets[lo:hi] - 8 * begin, self.payload[begin:end], self.book.max_bits
        # 32 bits from any byte: max_bits and the offset within the byte fit into them
        wide = (p[:-3].astype(np.int64) << 24) | (p[1:-2].astype(np.int64) << 16) | (p[2:-1].astype(np.int64) << 8) | p[3:]
        table, symbols, mask = self.book.table, self.book.symbols, (1 << bits) - 1
        lengths = self.book.lengths.astype(np.int64)
        for k in range(self.block_ids):
            if k == tail:  # the last block is over
                live -= 1
                if not live:
                    break
            a = at[:live]
            place = table[(wide[a >> 3] >> (32 - bits - (a & 7))) & mask]
            out[k, :live] = symbols[place]
            a += lengths[place]
        return out.T.reshape(-1)[:count]


_CACHES: dict[str, StretchCache] = {}


def library_cache(path: str) -> StretchCache:
    """The tokenizers library's ids of whole texts, by remembered stretches; one a process and vocabulary."""
    if path not in _CACHES:
        library, spec = Tokenizer.from_file(path), VocabularySpec(path)
        whole = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        _CACHES[path] = StretchCache(spec, library_words(library, spec), whole)
    return _CACHES[path]


def id_frames(path: str, end_id: int, width: int):
    """For mapInArrow over (id, text): (id, n_ids, ids) with the end id after each text's ids, width bytes each."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = library_cache(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids = [cache.encode(t.as_py()) + end for t in b.column(1)]
            packed = ids if width == 4 else [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(packed, pa.binary())], ["id", "n_ids", "ids"])

    return run


def count_frames(width: int):
    """For mapInArrow over (ids): (token, n), summed over the task's rows."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            if raw := b"".join(b.column(0).to_pylist()):
                more = np.bincount(np.frombuffer(raw, f"<u{width}"))
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["token", "n"])

    return run


def shard_frames(book, width: int, shard_ids: int = SHARD_IDS):
    """For mapInArrow over one part's (id, n_ids, ids), sorted by id: (part, first, n_ids, image); documents stay whole."""
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, docs, counts, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def image():
            ids = np.frombuffer(b"".join(held), f"<u{width}")
            raw = shard_image(book.value, docs, counts, ids, first)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())], ["part", "first", "n_ids", "image"])

        for b in batches:
            for d, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs.append(NO_ID if d is None else d)
                counts.append(n)
                held.append(raw)
                size += n
                if size >= shard_ids:
                    yield image()
                    first, docs, counts, held, size = first + size, [], [], [], 0
        if docs:
            yield image()

    return run


def read_frames(book, offsets):
    """For mapInArrow over (part, image): a row per document with its place and the checksum of its ids."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = ShardReader(image.as_py(), book.value)
                ids = shard.decode().astype("<u4")
                ends = np.cumsum(shard.counts)
                starts = ends - shard.counts
                crc = [zlib.crc32(ids[s:e].data) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID), pa.array(starts + shard.first + offsets.value[part]), pa.array(shard.counts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def write_token_files(df: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, out: str | None = None) -> str:
    """Encode each whole text with the tokenizers library, add end_id, and write shards in ascending id order.

    Writes under ``out`` (a new folder of the shared one unless given), and gives its path: shards (part, first, n_ids,
    image) and book, one row with the code book's bytes; read_token_files needs nothing else. Null and empty texts are the
    end id alone. Documents without an id come first and are read back without one; those that share an id, or have none,
    follow one another in no fixed order. Counts cover all documents; what reaches the driver is one count a vocabulary entry.
    """
    spark = df.sparkSession
    small_batches(spark)
    out = out or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    width = 2 if max(end_id, Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1) < 1 << 16 else 4
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    ids = materialize(rows.mapInArrow(id_frames(path, end_id, width), "id long, n_ids long, ids binary"), "token-ids")
    counts = ids.select("ids").mapInArrow(count_frames(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    book = CodeBook.of({r.token: r.n for r in counts}, max_bits)
    spark.createDataFrame([(bytearray(book.to_bytes()),)], "book binary").coalesce(1).write.parquet(f"{out}/book")
    held = spark.sparkContext.broadcast(book)
    parts = ids.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id")
    shards = parts.mapInArrow(shard_frames(held, width), "part long, first long, n_ids long, image binary")
    shards.write.option("compression", "none").parquet(f"{out}/shards")  # images are dense already
    discard(ids)
    return out


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from what write_token_files wrote under out."""
    sc, shards = spark.sparkContext, spark.read.parquet(f"{out}/shards")
    sizes = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row a shuffle partition
    at, offsets = 0, {}
    for part in sorted(sizes):
        offsets[part] = at
        at += sizes[part]
    held = sc.broadcast(CodeBook.from_bytes(bytes(spark.read.parquet(f"{out}/book").first()["book"])))
    return shards.select("part", "image").mapInArrow(read_frames(held, sc.broadcast(offsets)), "doc_id long, start long, n_tokens long, ids_crc32 long")
