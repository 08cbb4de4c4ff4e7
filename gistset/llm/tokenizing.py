"""Exact, cached tokenization of whole texts with a tokenizer of the ``tokenizers`` library.

A text is cut into chunks at places that no pre-token of the tokenizer spans, so that the text's
ids are the concatenation of its chunks' ids. A worker remembers the ids of the chunks it has
seen (a bounded memory), and gives the library only new ones.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct

import regex

# White space as the tokenizers' patterns have it (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"
#: A space goes with the word after it; a longer run of white space leaves it its last space.
_KEEPING = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_BLANK = re.compile(f"[{SPACE}]")
_DROPPING = re.compile(f"[^{SPACE}]+")
_ODD = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the tokenizers do not


def _keep(text: str) -> list[str]:
    return _KEEPING.findall(text)


def _split_dropping(text: str) -> list[str]:
    return _DROPPING.findall(text) if _ODD.search(text) else text.split()


def chunker(spec: dict):
    """The function that cuts texts for a tokenizer file's contents; whole texts where none is known to be safe."""
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    if any(re.search(f"[{SPACE}]", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return lambda text: [text] if text else []
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        return _keep
    first = (pre.get("pretokenizers") or [{}])[0]
    if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in str((first.get("pattern") or {}).get("Regex")):
        return _split_dropping
    return lambda text: [text] if text else []


# The tokenizers' own patterns, as they read on ASCII text (fixed values).
_ASCII_KEEPING = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_ASCII_DROPPING = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+", re.ASCII)
#: Byte-level alphabets show printable Latin-1 bytes as they are and the others, in order, as the characters from U+0100.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTE_SIGNS = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
_SIGN_OF_BYTE = "".join(_BYTE_SIGNS.get(b, chr(b)) for b in range(256))

#: Beyond ASCII, signs whose class and lower case every Unicode version gives alike and which NFC leaves alone:
#: Latin without dotted capital I, Cyrillic, dashes and quotes, ideographic punctuation, kana, ideographs.
_SETTLED = re.compile("[\x00-\x7f\xa1-\xac\xae-\u012f\u0131-\u017e\u0400-\u045f\u2010-\u2026\u3001-\u3003\u3008-\u3011\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5]*")
# The same patterns on such signs (fixed values); chunks hold no white space but one space before the word.
_SETTLED_KEEPING = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+")
_SETTLED_DROPPING = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


_PACKS = [struct.Struct(f"<{n}I").pack for n in range(24)]


class Splitter:
    """Cuts a text into chunks, and a chunk into the words that the tokenizer's model gets.

    ASCII chunks of the known kinds of tokenizer, and chunks of settled signs, are cut here, all
    else by the file's own normaliser and pre-tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.plain_cut = cut = chunker(self.spec)
        self.pattern = {_keep: _ASCII_KEEPING, _split_dropping: _ASCII_DROPPING}.get(cut)
        self.settled = {_keep: _SETTLED_KEEPING, _split_dropping: _SETTLED_DROPPING}.get(cut)
        self.lower = cut is _split_dropping
        self.normalizer, self.pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if self.lower and [n.get("type") for n in (self.spec.get("normalizer") or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            self.pattern = None
        added = sorted((t["content"] for t in self.spec.get("added_tokens") or []), key=len, reverse=True)
        #: The strings that the library takes out of a text before all else.
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        #: These cut a text before all else: white space before one ends there. Whole-text chunks hold them instead.
        self.cutting = added if cut in (_keep, _split_dropping) else []
        if self.pattern and any(len(self.pattern.findall(t)) < 2 for t in added):
            self.pattern = None  # a piece could read like an added token

    def cut(self, text: str) -> list[str]:
        """The chunks of a text; an added token is a chunk."""
        if not any(t in text for t in self.cutting):
            return self.plain_cut(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += self.plain_cut(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.plain_cut(text[at:])

    def pieces(self, chunk: str) -> list[str] | None:
        """The words of a chunk as plain text, where it is cut here; None where the file's own steps must cut it."""
        if self.pattern is None:
            return None
        if chunk.isascii():
            if chunk.isalpha():  # letters alone are one word in either pattern
                return [chunk.lower() if self.lower else chunk]
            return self.pattern.findall(chunk.lower() if self.lower else chunk)
        if _SETTLED.fullmatch(chunk):
            return self.settled.findall(chunk.lower() if self.lower else chunk)
        return None

    @staticmethod
    def signs(piece: str) -> str:
        """A piece in the alphabet of the model."""
        if piece.isascii() and piece.isalpha():
            return piece
        return piece.translate(_BYTE_SIGNS) if piece.isascii() else codecs.charmap_decode(piece.encode(), "strict", _SIGN_OF_BYTE)[0]

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk that holds no added token, in the alphabet of the model."""
        if (pieces := self.pieces(chunk)) is not None:
            return list(map(self.signs, pieces))
        if self.normalizer:
            chunk = self.normalizer.normalize_str(chunk)
        return [w for w, _ in self.pre.pre_tokenize_str(chunk) if w] if self.pre else [chunk]


class _Memory(dict):
    """Ids of chunks; a missing one is made by ``make`` and, if short, remembered: ``most`` recent ones, and as many before them."""

    def __init__(self, make, most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


class _Loose(Exception):
    """A space that does not stand before a word: the text is cut as a whole."""


class ChunkEncoder:
    """Encodes texts; up to ``most`` recent chunks of at most ``longest`` signs are remembered, and as many before them."""

    def __init__(self, path: str, most: int = 270_000, longest: int = 64):
        self.split = Splitter(path)
        self.split.spec = {}  # the library holds the model
        self.tokenize = self.split.tokenizer.model.tokenize
        self.spaced = self.split.pattern is _ASCII_KEEPING  # a space goes with the letters after it
        #: Ids of chunks and of their pieces alike: a piece is cut into itself, so as a chunk it has the same ids.
        self.chunks = _Memory(self._new, most if not self.spaced else most // 8, longest)
        #: Ids of what follows a space, that space included, up to the next one.
        self.after = _Memory(self._new_after, most, longest)

    def _model(self, word: str) -> bytes:
        ids = [x.id for x in self.tokenize(word)]
        return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else struct.pack(f"<{len(ids)}I", *ids)

    def _new(self, chunk: str) -> bytes:
        """The ids of a chunk that the memory lacks."""
        split = self.split
        if self.spaced and chunk[0] == " " and (word := chunk[1:]).isalpha():
            return self.after[word]
        if split.added and split.added.search(chunk):
            ids = split.tokenizer.encode(chunk, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        pieces = split.pieces(chunk)
        if pieces is None:
            return b"".join(map(self._model, split.words(chunk)))
        if len(pieces) == 1 and pieces[0] == chunk:
            return self._model(split.signs(chunk))
        return b"".join(map(self.chunks.__getitem__, pieces))

    def _new_after(self, part: str) -> bytes:
        """The ids of a space and the part of a text that follows it up to the next space."""
        if part.isalpha():
            if part.isascii():
                return self._model(_BYTE_SIGNS[32] + part)
            if _SETTLED.fullmatch(part):
                return self._model(_BYTE_SIGNS[32] + self.split.signs(part))
            return b"".join(map(self._model, self.split.words(" " + part)))
        if not part or _BLANK.match(part):
            raise _Loose
        if (word := part[:-1]).isalpha() and part[-1] in ",." and _SETTLED.fullmatch(word):
            return self.after[word] + self.chunks[part[-1]]
        first, *more = self.split.plain_cut(" " + part)
        if not more:
            return self._new(first)
        return self.after[first[1:]] + b"".join(map(self.chunks.__getitem__, more))

    def _spaced(self, text: str) -> bytes:
        """The ids of a text cut at its spaces, each of which goes with the word after it."""
        first, *rest = text.split(" ")
        return b"".join(map(self.chunks.__getitem__, self.split.plain_cut(first))) + b"".join(map(self.after.__getitem__, rest))

    def _ids(self, text: str) -> bytes:
        if self.spaced and not any(t in text for t in self.split.cutting):
            try:
                return self._spaced(text)
            except _Loose:
                pass
        return b"".join(map(self.chunks.__getitem__, self.split.cut(text)))

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers, then ``end_id``; null is empty."""
        end = b"" if end_id is None else struct.pack("<I", end_id)
        return [self._ids(t) + end if t else end for t in texts]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
