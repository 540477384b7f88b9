"""Exact ids of the public tokenizers at several times their speed: words are encoded once and then looked up.

Byte-pair merges never cross a pre-token, and white space never lies within one, so a text's ids are those of its
white-space-delimited words one after another. Words met before come from a cache of bounded size; texts whose white space
is out of the ordinary go to the tokenizer whole.
"""

from __future__ import annotations

import array
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from porelake.llm.common import KEPT

#: Words a worker remembers, starting anew beyond them, and bytes of texts that encode_batch() takes at once.
CACHE_WORDS, BATCH_CHARS = 400_000, 4 << 20

#: White space that Python and the tokenizers may see differently, or that isn't ASCII.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
#: White space next to white space, or other than blanks and line ends.
_KNOTTED = re.compile(r"[ \t-\r][ \t-\r]|[\t\v\f\r]")
_SPACED = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_ENDS = ".,;:!?"
#: The same two for Arrow's regular expressions; a text that begins or ends with a blank is knotted too.
_ODD_RE2 = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"
_KNOTTED_RE2 = r"[ \t\n\v\f\r][ \t\n\v\f\r]|[\t\v\f\r]|^ | $"


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, nxt = [], 0x100
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(nxt))
            nxt += 1
    return out


#: From UTF-8 bytes, read as Latin-1, to their stand-ins.
_LETTERS = dict(enumerate(_byte_letters()))


class _Cache(dict):
    def __init__(self, encode, most: int) -> None:
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = self.encode(word)
        return ids


def _pack(ids: list[int]) -> bytes:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Encoder:
    """encode(text) gives little-endian unsigned 32-bit ids, without special tokens; their strings in a text are plain text."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, batch_chars: int = BATCH_CHARS) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenize = self.tokenizer.model.tokenize
        made = json.loads(self.tokenizer.to_str())
        self.lower = "owercase" in json.dumps(made.get("normalizer"))
        self.spaced = (made.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.lead = _LETTERS[0x20] if self.spaced else ""
        self.blank = " " if self.spaced else ""
        self.ends = {mark: self.whole(mark) for mark in _ENDS}
        self.line_end = self.whole("\n") if self.spaced else b""
        self.batch_chars = batch_chars
        self.cache = _Cache(self._word, cache_words)
        self.unspaced = _Cache(self.whole, cache_words)

    def whole(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _stem(self, lead: str, stem: str) -> bytes:
        if self.lower:
            stem = stem.lower()
        return _pack([t.id for t in self.tokenize(lead + (stem if stem.isascii() else stem.encode().decode("latin-1").translate(_LETTERS)))])

    def _word(self, word: str) -> bytes:
        """A word's ids, after a blank if blanks are part of tokens, or after the line end that it begins with.

        Latin-1 letters alone are one pre-token, with an end mark two; all else goes to the tokenizer.
        """
        if word[:1] == "\n":
            return self.line_end + self._start(word[1:])
        end = word[-1:]
        if end in self.ends:
            stem = word[:-1]
            if stem.isalpha() and (stem.isascii() or max(stem) < "Ā"):
                return (self.cache.get(stem) or self._stem(self.lead, stem)) + self.ends[end]
        elif word.isalpha() and (word.isascii() or max(word) < "Ā"):
            return self._stem(self.lead, word)
        return self.whole(self.blank + word)

    def _start(self, word: str) -> bytes:
        """The ids of a word without a blank before it."""
        if word.isalpha() and (word.isascii() or max(word) < "Ā"):
            return self._stem("", word)
        return self.whole(word)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return self.whole(text)
        if not self.spaced:
            return b"".join(map(self.cache.__getitem__, text.split()))
        if _KNOTTED.search(text) or text[0] == " " or text[-1] == " ":
            return b"".join(map(self.unspaced.__getitem__, _SPACED.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return self._start(first) + b"".join(map(self.cache.__getitem__, rest))


    def encode_batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, end_id behind each, and the n + 1 places where they begin and end.

        Words are split and made distinct by Arrow, so each distinct word of a batch is looked up once; null is empty.
        """
        parts, sizes = [], []
        for at, n in _slices(texts, self.batch_chars):
            ids, size = self._some(texts.slice(at, n), end_id)
            parts.append(ids), sizes.append(size)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)

    def _some(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD_RE2 + ("|" + _KNOTTED_RE2 if self.spaced else "")).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        if self.spaced:
            lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        else:
            lists = pc.ascii_split_whitespace(plain)
        begins = lists.offsets.to_numpy().astype(np.int64)
        begins = begins - begins[0]
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_pylist()
        found = [self.cache[w] if w else b"" for w in words]
        if self.spaced:
            # the first word of a text has no blank before it
            first = begins[:-1]
            starts = [self._start(words[k]) if words[k] else b"" for k in index[first].tolist()]
            index[first] = np.arange(len(found), len(found) + len(first))
            found += starts
        slow = np.flatnonzero(odd).tolist()
        last = np.arange(len(found), len(found) + len(texts))  # what ends each text: its ids if it is odd, and end_id
        end = np.array([end_id], "<u4").tobytes()
        ends = [end] * len(texts)
        for i, text in zip(slow, texts.take(pa.array(slow, pa.int64())).to_pylist()):
            ends[i] = self.encode(text) + end
        found += ends
        index = np.insert(index, begins[1:], last)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        size = lengths[index]
        place = np.cumsum(size) - size
        total = int(size.sum())
        kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        source = np.repeat(((np.cumsum(lengths) - lengths)[index] - place).astype(kind), size)
        source += np.arange(total, dtype=kind)
        ids = flat[source]
        stops = begins[1:] + np.arange(1, len(texts) + 1)
        edges = np.concatenate([place, [total]])[np.concatenate([[0], stops])]
        return ids, np.diff(edges)


def _slices(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Runs of texts of about so many bytes: at, number."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    out, at, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            out.append((at, i - at))
            at, held = i, 0
        held += n
    return [*out, (at, len(sizes) - at)] if len(sizes) > at else out


_ENCODERS: dict[str, Encoder] = KEPT.setdefault("tokens", {})


def encoder(path: str, cache_words: int = CACHE_WORDS, batch_chars: int = BATCH_CHARS) -> Encoder:
    """The worker's encoder for a vocabulary file; it and its cache live on from task to task of one operator."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, cache_words, batch_chars)
    return _ENCODERS[path]
