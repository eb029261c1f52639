"""Exact token ids of the public tokenizers, with a memo of short units.

A text is cut where the tokenizer's own pre-tokenizer always cuts, each distinct unit is encoded once by the
tokenizers library and remembered, and the ids are joined. Units outside a plain alphabet (printable ASCII, line ends
and the letters of Latin-1), where library versions of Unicode could differ, go to the library's full encoder as they
are. Strings of special tokens within a text become special tokens, as the library's encode() has it: a text that may
hold one goes to the library whole. With special_as_text=True they are ordinary text, so that no document can forge a
boundary.
"""

from __future__ import annotations

import os
import re
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units remembered by a Python worker in each of two generations: when the younger is full it becomes the older.
#: Bounds memory, not results.
MEMO_UNITS = {"byte": 500_000, "word": 300_000}
#: Longer units aren't remembered.
MEMO_CHARS = 64

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN = re.compile(f"[\n!-~{LETTER}×÷]*")
ODD = re.compile(f"[^\n -~{LETTER}×÷]")
CLEAN_SPACE = re.compile(f"(?<=[!-~{LETTER}×÷]) (?=[!-~{LETTER}×÷])")
#: The patterns of the two pre-tokenizers, over the plain alphabet.
BYTE_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")
WORD_PIECE = re.compile(rf"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[{LETTER}]+|[0-9]|[^\s{LETTER}0-9]+")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level tokenizers show each byte as: itself if visible, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Ids:
    """Encodes texts to little-endian unsigned 32-bit ids. kind: "byte" (spaces belong to units) or "word" (spaces are dropped).

    The memo's keys are units without the space before them. To a "byte" tokenizer a unit stands for itself behind a
    space, or, if it begins with a line end, for itself, or, if it begins with `FIRST`, for what follows that.
    """

    #: Control characters, which no plain text has: before a text's first unit, and before the number of a text that isn't plain.
    FIRST, OTHER = "\x00", "\x01"

    def __init__(self, path: str, kind: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        specials = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What a text holds if it holds a special token.
        self.special = {x[:2] for x in specials}
        self.tokenize = self.tokenizer.model.tokenize
        #: The four bytes of each id.
        self.coded = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.kind, self.room = kind, MEMO_UNITS[kind]
        self.space = " " if kind == "byte" else ""
        self.piece = (BYTE_PIECE if kind == "byte" else WORD_PIECE).findall
        self.shown = "".join(byte_alphabet())
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empties the memos, for workers that go on to other work."""
        self.memo, self.older, self.pieces = {}, {}, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, piece: str) -> bytes:
        """The ids of one piece of the pre-tokenizer."""
        if self.kind == "word":
            piece = piece.lower()
        coded = self.coded
        return b"".join([coded[t.id] for t in self.tokenize(piece if piece.isalpha() and piece.isascii() else charmap_decode(piece.encode(), "strict", self.shown)[0])])

    def piece_ids(self, piece: str) -> bytes:
        """The ids of a piece that is no word, such as a run of marks."""
        found = self.pieces.get(piece)
        if found is None:
            found = self.letters(piece)
            if len(self.pieces) >= self.room // 5:
                self.pieces.clear()
            if len(piece) <= MEMO_CHARS:
                self.pieces[piece] = found
        return found

    def looked_up(self, units: list[str]) -> list[bytes]:
        """The ids of each unit."""
        if len(self.memo) >= self.room:
            self.older, self.memo = self.memo, {}
        memo, older, letters, space, marks = self.memo, self.older.get, self.letters, self.space, self.piece_ids
        found = list(map(memo.get, units))
        for i, ids in enumerate(found):
            if ids is not None:
                continue
            unit = units[i]
            # words are remembered without the marks behind them, which are a piece of their own
            word = unit.rstrip(MARKS)
            plain = word.isalpha() and (word.isascii() or max(word) < "Ā")
            if not plain:
                word = unit
            ids = memo.get(word)
            if ids is None:
                ids = older(word)
                if ids is None:
                    ids = letters(space + word) if plain else self.after_space(unit)
                if len(word) <= MEMO_CHARS:
                    memo[word] = ids
            found[i] = ids if len(word) == len(unit) else ids + marks(unit[len(word) :])
        return found

    def after_space(self, unit: str) -> bytes:
        if self.kind == "word":
            return self.unit(unit, "")
        if unit[:1] == "\n":
            return self.piece_ids("\n") + self.unit(unit[1:], "")
        return self.unit(unit[1:], "") if unit[:1] == self.FIRST else self.unit(unit, " ")

    def unit(self, core: str, space: str) -> bytes:
        """The ids of a unit behind a space (or nothing)."""
        if not core:
            return b""
        # a word, or a word and marks: the marks are a piece of their own
        word = core.rstrip(MARKS)
        if word.isalpha() and (word.isascii() or max(word) < "Ā"):
            return self.letters(space + word) + (self.piece_ids(core[len(word) :]) if len(word) != len(core) else b"")
        if not PLAIN.fullmatch(core):
            return self.whole(space + core)
        return b"".join(map(self.piece_ids, self.piece(space + core)))

    def prepared(self, text: str) -> str | None:
        """The text with a space wherever units part; None if it isn't plain."""
        if ODD.search(text):
            return None
        if any(mark in text for mark in self.special):
            return None
        if self.kind == "word":
            return text.replace("\n", " ")
        # every space, and every line end, must stand between two visible plain characters
        text = text.replace("\n", " \n")
        return None if "  " in text or "\n " in text or text[0] == " " or text[-1] in " \n" else self.FIRST + text

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        if not text:
            return b""
        if any(mark in text for mark in self.special):
            return self.whole(text)
        if self.kind == "word":
            # [\x1c-\x1f] are spaces to str.split() but not to the tokenizer
            units = text.split() if not ODD.search(text) else re.split("[ \t\n\r]+", text)
            return b"".join(self.looked_up(units))
        units = CLEAN_SPACE.split(text)
        return self.unit(units[0], "") + b"".join(self.looked_up(units[1:]))

    def encode_all(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id, one behind the other; and each text's number of ids.

        Distinct units are looked up once for all texts, so most of the work for a token is Arrow's and NumPy's.
        """
        if not texts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        ready = [self.prepared(t) if t else "" for t in texts]
        parts = pc.split_pattern(pa.array([f"{self.OTHER}{i}" if r is None else r for i, r in enumerate(ready)], pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        cuts, code = parts.offsets.to_numpy(), coded.indices.to_numpy()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        others = {k: u for k, u in enumerate(units) if u[:1] == self.OTHER}
        for k in others:
            units[k] = ""
        found = self.looked_up(units)
        for k, u in others.items():
            found[k] = self.encode(texts[int(u[1:])])
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        number = np.int32 if size[code].sum() < 1 << 31 else np.int64
        start, size = (np.cumsum(size) - size).astype(number), size.astype(number)
        held = np.frombuffer(b"".join(found), "<u4")
        n = size[code]
        upto = np.concatenate((np.zeros(1, number), np.cumsum(n, dtype=number)))
        counts = (upto[cuts[1:]] - upto[cuts[:-1]]).astype(np.int64)
        source = np.repeat(start[code] - upto[:-1], n)
        source += np.arange(len(source), dtype=number)
        # a place for the end id behind each text
        ends = np.cumsum(counts + 1) - 1
        out = np.empty(len(source) + len(texts), "<u4")
        plain = np.ones(len(out), bool)
        plain[ends] = False
        out[plain] = held[source]
        out[ends] = end_id
        return out, counts + 1


_LOADED: dict[tuple[str, str, bool], Ids] = {}


def loaded(path: str, kind: str, special_as_text: bool = False) -> Ids:
    """One encoder for each Python worker process, kept between its tasks; another one takes its place."""
    key = path, kind, special_as_text
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Ids(*key)
    return _LOADED[key]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
