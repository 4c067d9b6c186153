"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that no vocabulary token holds can never end up inside one token: wherever it
occurs the encoder must cut. Each pre-token is split at all such pairs and its fragments are merged
independently, which gives the same tokens as merging the whole and keeps merges short.

The pre-tokeniser and normaliser are those of the vocabulary file: Unicode composition, white space, lower
case, then contractions, runs of letters, single digits, runs of others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex

from quarry.llm.common import small_batches
from quarry.llm.pretokens import StretchCache, VocabularySpec

#: The byte alphabet of byte-level vocabularies keeps these bytes as they are ...
_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: ... and puts the others, in order, from this code point on.
_MOVED = 0x100
#: Fixed value: white space as the vocabulary's normaliser sees it.
_SPACES = "\t\n\v\f\r \x85\xa0  -     　"


def byte_alphabet() -> list[str]:
    moved = iter(range(_MOVED, _MOVED + 256))
    kept = set(_KEPT)
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder for one vocabulary file (byte-level BPE with or without a word-end mark).

    encode(None) and encode('') are empty. Special tokens standing in a text become their own ids, as the file
    asks. Up to ``cache_words`` stretches and words are remembered.
    """

    def __init__(self, path: str, cache_words: int = 250_000):
        from tokenizers import Tokenizer

        self.spec = VocabularySpec(path)
        spec = self.spec.raw
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        #: rank of a pair of token ids, and the id each rank makes
        self.rank = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.makes = [self.vocab[a + b] for a, b in pairs]
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens: list[str] = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split.replace(r"\s", _SPACES))
        library = Tokenizer.from_file(path)
        self._normalizer, self._pre = library.normalizer, library.pre_tokenizer
        self._inside, self._final = self._pairs()
        self._single = [self.vocab[c] for c in self.alphabet]
        self._ending = [self.vocab[c + self.suffix] for c in self.alphabet]
        self._cache = StretchCache(self.spec, lambda words: [self.word_ids(w) for w in words], self._whole, cache_words)

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Which byte pairs stand inside some token; apart, those whose second byte bears the word-end mark."""
        at = {c: b for b, c in enumerate(self.alphabet)}
        inside, final = np.zeros((256, 256), bool), np.zeros((256, 256), bool)
        for token in self.vocab:
            ended = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            raw = [at.get(c) for c in (token[: -len(self.suffix)] if ended else token)]
            if None in raw:
                continue
            for k in range(len(raw) - 1):
                (final if ended and k == len(raw) - 2 else inside)[raw[k], raw[k + 1]] = True
        return inside, final

    def fragments(self, word: bytes) -> list[tuple[bytes, bool]]:
        """The forced pieces of a pre-token, with whether the piece bears the word-end mark."""
        out, start, last = [], 0, len(word) - 1
        for i in range(last):
            pairs = self._final if i + 1 == last and self.suffix else self._inside
            if not pairs[word[i], word[i + 1]]:
                out.append((word[start : i + 1], False))
                start = i + 1
        out.append((word[start:], True))
        return out

    def _merge(self, piece: bytes, ended: bool) -> list[int]:
        """Merge by rank, the leftmost of the lowest first; only the pairs beside a merge change."""
        ids = [self._single[b] for b in piece]
        if ended:
            ids[-1] = self._ending[piece[-1]]
        get, none = self.rank.get, len(self.makes)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at] = self.makes[best]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(ids[at] << 20 | ids[at + 1], none)
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | ids[at], none)
        return ids

    def word_ids(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        return np.array([i for piece, ended in self.fragments(word.encode()) for i in self._merge(piece, ended)], "<u4").tobytes()

    def pretokens(self, text: str) -> list[str]:
        norm = self._normalizer.normalize_str(text)
        if max(norm, default="") <= "\u024f":
            return self._words.findall(norm)
        back = {c: b for b, c in enumerate(self.alphabet)}  # letters of rarer scripts: classes as the library has them
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self._pre.pre_tokenize_str(norm)]

    def _plain(self, text: str) -> bytes:
        return b"".join([self.word_ids(w) for w in self.pretokens(text)])

    def _whole(self, text: str) -> bytes:
        """A text with special tokens, or with characters whose case or composition only the library's normaliser knows."""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        return b"".join(np.array([self.special[part]], "<u4").tobytes() if part in self.special else self._plain(part) for part in self._special.split(text) if part)

    def encode_bytes(self, text: str | None) -> bytes:
        return self._cache.encode(text)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode(self, ids) -> str:
        """As a vocabulary without a decoder decodes: tokens, specials included, with a space between."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])


_MADE: dict[str, ForcedBoundaryBPE] = {}


def encoder(path: str) -> ForcedBoundaryBPE:
    """One encoder a process and vocabulary."""
    if path not in _MADE:
        _MADE[path] = ForcedBoundaryBPE(path)
    return _MADE[path]


def bpe_frames(path: str, keep_text: bool = False):
    """For mapInArrow over (id long, text string): id, n_tokens, ids as binary, decoded text (and the text)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for rows in slices(batch):
                texts = rows.column(1).to_pylist()
                ids = [bpe.encode_bytes(t) for t in texts]
                cols = [rows.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(cols + ([rows.column(1)] if keep_text else []), ["id", "n_tokens", "ids", "decoded"] + ["text"] * keep_text)

    return run


def slices(batch, most_bytes: int = 4 << 20):
    """A record batch in runs of rows of about most_bytes at most; a longer row stands alone."""
    per = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, per):
        yield batch.slice(at, per)


def bpe_roundtrip(df, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """(id, n_tokens, ids binary, decoded): each whole text encoded, then decoded from its ids.

    Null and empty texts give no ids and the empty text. Row order, repeated rows and other columns do not
    matter; one output row per input row.
    """
    small_batches(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(bpe_frames(path), "id long, n_tokens long, ids binary, decoded string")


def digest_frames(path: str):
    """For mapInArrow over (id, text): the ids and the decoded text as digests, without carrying either out."""
    import hashlib

    import pyarrow as pa

    inner = bpe_frames(path)

    def run(batches):
        for out in inner(batches):
            ids, decoded = out.column(2).to_pylist(), out.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [out.column(0), out.column(1), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def bpe_digests(df, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of bpe_roundtrip's rows."""
    small_batches(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(digest_frames(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_frames(path: str, at: int):
    """For mapInArrow over whole rows with the text in column at: the other columns, n_tokens, token_ids, decoded_sha256."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        bpe = encoder(path)
        for b in batches:
            raw = [bpe.encode_bytes(t.as_py()) for t in b.column(at)]
            sizes = [len(x) // 4 for x in raw]
            ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))
            back = [hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4")).encode()).hexdigest() for x in raw]
            rest = [(n, c) for k, (n, c) in enumerate(zip(b.schema.names, b.columns, strict=True)) if k != at]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(sizes, pa.int64()), ids, pa.array(back)], [*(n for n, _ in rest), "n_tokens", "token_ids", "decoded_sha256"])

    return run


def tokenize(df, path: str, text_col: str = "text"):
    """Training rows: df's columns but the text, with n_tokens, token_ids and decoded_sha256 (which take the place of columns of
    these names). Null and empty texts have no ids."""
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in (text_col, "n_tokens", "token_ids", "decoded_sha256")]
    rows = df.select(*[df[c] for c in keep], df[text_col].cast("string").alias("_text"))
    schema = StructType(rows.schema.fields[:-1]).add("n_tokens", "long").add("token_ids", ArrayType(IntegerType())).add("decoded_sha256", "string")
    return rows.mapInArrow(token_frames(path, len(keep)), schema)
