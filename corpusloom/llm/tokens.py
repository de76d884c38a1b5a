"""Ids of a public tokenizer file, computed once per distinct word.

``Encoder`` gives exactly what ``Tokenizer.encode(text, add_special_tokens=False)`` gives, which makes one id of
a special token's string in a text; ``plain_specials`` takes such strings as ordinary text instead.  Both
supported pre-tokenizers cut a text at places that can be found without them, so a text is cut there and each
distinct piece is encoded once per Python worker:

* word scheme (white space normalised and dropped): at ASCII spaces and newlines;
* byte scheme: before the last space of a run, with the other white space as pieces of its own.

A text with white space of any other kind, or with a special token's string, and any other scheme, is encoded
whole.  What a worker remembers is bounded in bytes, and long words aren't remembered.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Bytes of words of either kind, and of pieces, that a worker remembers; beyond them they are encoded each time.
WORD_BYTES, PIECE_BYTES = 120 << 20, 140 << 20
#: Longer words aren't remembered.  A remembered one takes so many bytes beside its own.
LONGEST, BESIDE = 128, 180
#: Letters of European alphabets that are alike in every normal form, and their lower case one letter.
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
#: Words and pieces whose pre-tokens the two patterns below find as the library does.
PLAIN = re.compile(f" ?[!-~{LETTER}]+")

#: White space other than the ASCII space and newline, as either library sees it.
ODD_SPACE = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: White space that isn't one character between two words.
RUNS = re.compile(r"[ \n](?:[ \n]|\Z)|\A[ \n]")
CHUNK = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
#: The two pre-tokenizers' own patterns, for plain words (fixed by the vocabulary files).
WORD_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\\s0-9{LETTER}]+")
BYTE_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\\s0-9{LETTER}]+|\\s+(?!\\S)|\\s+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    out, free = [], 256
    for b in range(256):
        prints = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b) if prints else chr(free))
        free += not prints
    return out


BYTE_LETTER = _byte_letters()

_encoders: dict[tuple[str, bool], Encoder] = {}


class _Memo(dict):
    """Missing keys are computed, and remembered while there is room."""

    def __init__(self, make, room: int):
        self.make, self.room = make, room

    def __missing__(self, key):
        value = self.make(key)
        if self.room > 0 and len(key) <= LONGEST:
            self.room -= 4 * len(key) + len(value) + BESIDE
            self[key] = value
        return value


class Encoder:
    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [x["content"] for x in spec.get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, added)), re.I) if added and not plain_specials else None
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.scheme = self._scheme(spec)
        self.model = self.tokenizer.model
        self.pieces = _Memo(self._piece, PIECE_BYTES)
        self.words = _Memo(self._by_piece, WORD_BYTES)
        self.spaced = _Memo(lambda word: self._by_piece(" " + word), WORD_BYTES)

    @staticmethod
    def _scheme(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "byte"
        steps = [x.get("type") for x in norm.get("normalizers", [])]
        cuts = [x.get("type") for x in pre.get("pretokenizers", [])]
        return "word" if steps == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"] else "whole"

    def _encode(self, text: str) -> bytes:
        return b"" if not text else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A plain pre-token goes to the library's model as it is, but for its bytes' letters."""
        spelt = piece if piece.isascii() and piece[0] != " " else "".join(map(BYTE_LETTER.__getitem__, piece.encode()))
        return np.array([t.id for t in self.model.tokenize(spelt)], self.width).tobytes()

    def _by_piece(self, word: str) -> bytes:
        if not PLAIN.fullmatch(word):
            return self._encode(word)
        found = WORD_PIECE.findall(word.lower()) if self.scheme == "word" else BYTE_PIECE.findall(word)
        return b"".join(map(self.pieces.__getitem__, found))

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text; null is empty."""
        if not text:
            return np.empty(0, self.width)
        if self.scheme == "whole" or ODD_SPACE.search(text) or (self.special and self.special.search(text)):
            return np.frombuffer(self._encode(text), self.width)
        if self.scheme == "word":
            found = map(self.words.__getitem__, text.replace("\n", " ").split(" "))
        elif RUNS.search(text):
            found = map(self.words.__getitem__, CHUNK.findall(text))
        else:  # single spaces and newlines between words: spaces belong to what follows
            found = []
            for i, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                found += [self.words["\n"]] * (i > 0)
                found.append(self.words[first])
                found.extend(map(self.spaced.__getitem__, rest))
        return np.frombuffer(b"".join(found), self.width)


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """This worker's encoder of the vocabulary file at path."""
    key = (path, plain_specials)
    if key not in _encoders:
        _encoders[key] = Encoder(path, plain_specials)
    return _encoders[key]
