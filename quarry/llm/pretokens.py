"""Texts to token ids by remembered pieces.

A vocabulary that cuts at white space first encodes each stretch between spaces on its own, and each pre-token in it
likewise. So a text's ids are those of its stretches in order, and a stretch met before need not be encoded again.
Both memories stop growing at a bound; what comes later is encoded each time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

#: The classes of the vocabulary's pattern among the first 256 characters, in lower case.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\t\n\v\f\r \x85\xa0"
#: Fixed value: the pattern this module knows how to follow.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}{_SPACES}]+")
#: str.split takes these for white space; the vocabulary does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


class VocabularySpec:
    """What a tokenizer file says of normalising, cutting and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.raw = json.load(f)
        pre = self.raw.get("pre_tokenizer") or {}
        splits = [p for p in pre.get("pretokenizers", [pre]) if p.get("type") == "Split"]
        norm = self.raw.get("normalizer") or {}
        kinds = [n.get("type") for n in norm.get("normalizers", [])]
        self.by_stretch = (
            len(splits) == 1 and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and splits[0]["pattern"].get("Regex") == KNOWN_PATTERN
            and kinds == ["NFC", "Replace", "Lowercase"] and not self.raw.get("post_processor")
        )
        self.special = {t["content"]: t["id"] for t in self.raw.get("added_tokens", [])}


class StretchCache:
    """encode(text) -> ids as little-endian unsigned 32-bit integers.

    words_to_ids encodes pre-tokens; whole encodes a text this class may not cut: one with characters beyond the first
    256 (their composition and case depend on more than a character), with a special token's string, or with
    separators on which the two notions of white space differ.
    """

    def __init__(self, spec: VocabularySpec, words_to_ids: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], most: int = 500_000):
        self.spec, self.words_to_ids, self.whole, self.most = spec, words_to_ids, whole, most
        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self._first = {s[0] for s in spec.special}

    def can_cut(self, text: str) -> bool:
        if not self.spec.by_stretch:
            return False
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        if any(c in text for c in _SEPARATORS):
            return False
        return not any(c in text and any(s in text for s in self.spec.special) for c in self._first)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.can_cut(text):
            return self.whole(text)
        parts = text.lower().split()
        got = list(map(self.stretches.get, parts))
        if None in got:
            new = self._learn({p for p, ids in zip(parts, got, strict=True) if ids is None})
            got = [new[p] if ids is None else ids for p, ids in zip(parts, got, strict=True)]
        return b"".join(got)

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of stretches that aren't remembered; from now on they are, while there is room."""
        new, words = {p: _WORDS.findall(p) for p in parts}, self.words
        lacking = list({w for ws in new.values() for w in ws if w not in words})
        made = dict(zip(lacking, self.words_to_ids(lacking), strict=True)) if lacking else {}
        if len(words) + len(made) <= self.most:
            words.update(made)
            made = {}
        fresh = {p: words[ws[0]] if len(ws) == 1 and ws[0] in words else b"".join([words[w] if w in words else made[w] for w in ws]) for p, ws in new.items()}
        if len(self.stretches) + len(fresh) <= self.most:
            self.stretches.update(fresh)
        return fresh


def library_words(library, spec: VocabularySpec) -> Callable[[list[str]], list[bytes]]:
    """Encodes pre-tokens with the tokenizers library: many at once, cut apart at the tokens that end a word."""
    from tokenizers import Tokenizer, pre_tokenizers

    from quarry.llm.bpe import byte_alphabet

    suffix = spec.raw["model"].get("end_of_word_suffix") or ""
    model = Tokenizer(library.model)
    model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    alphabet = byte_alphabet()
    table = {b: alphabet[b] for b in range(256) if b != 32}
    ends = np.zeros(library.get_vocab_size(), bool)
    for token, i in library.get_vocab().items():
        ends[i] = bool(suffix) and token.endswith(suffix)

    def run(words: list[str]) -> list[bytes]:
        if not suffix:
            return [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(words, add_special_tokens=False)]
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            text = " ".join(words[at : at + 4096]).encode().decode("latin-1").translate(table)
            ids = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(np.flatnonzero(ends[ids]) + 1).tolist()]
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    return run
