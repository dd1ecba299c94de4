"""Token ids of whole texts from a tokenizer file, with ids remembered for pieces that come again.

Both kinds of byte-pair tokenizers known here cut a text at white space before any merge, so a piece of text between
cuts has the same ids wherever it stands. Pieces repeat, and a bounded table of them saves most of the work. A piece
that is not in the table is cut further, at the borders of letters, digits and signs, where it has simple characters
only; the parts are pieces too. For any other tokenizer the whole text goes to the tokenizer as it is.
"""

from __future__ import annotations

import json
import os
import re
from array import array

# White space as Unicode's property of that name has it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# An optional space stays with the run after it; of a longer white-space run the last character stands apart.
_WITH_SPACE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WITHOUT_SPACE = re.compile(f"[^{_SPACE}]+")
# Characters that str.split() takes for white space beyond that property.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
# The split patterns of the two kinds, and what they come to for the characters of _SIMPLE.
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_SIMPLE = re.compile(f" ?[!-~{_LETTER}]+")
_LETTERS = re.compile(f"[{_LETTER}]+")
_SIMPLE_WITH_SPACE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^ {_LETTER}0-9]+")
_SIMPLE_WITHOUT_SPACE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^ {_LETTER}0-9]+")

# Byte-level merges work on printable characters: a byte that prints stands for itself, the others follow from 256 on.
_PRINTS = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
_BYTES = [chr(b) if _PRINTS[b] else chr(256 + b - sum(_PRINTS[:b])) for b in range(256)]

REMEMBERED = 800_000  # pieces in the tables of one Python worker, and as many that have stepped back
LONGEST_REMEMBERED = 64  # characters; longer pieces hardly come again

_encoders: dict[tuple[str, bool], Encoder] = {}


class _Table(dict):
    """Ids by piece; a missing piece is made and kept. The pieces of a full table step back: those that come again
    return, the others are forgotten when the table is full again."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None) or self.make(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class _OddSpace(Exception):
    """A word that holds white space, or none at all: the text has more than single spaces and line feeds."""


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        # As in the library: the strings of special tokens become these tokens, unless they shall be ordinary text.
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = [t for t in spec.get("added_tokens", []) if not (special_as_text and t["special"])]
        # Tokens outside the merges are found in the whole text; a text that may hold one goes to the tokenizer as it is.
        self.openings = sorted({t["content"][:2] for t in added})
        plain = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in added)
        self.kind = self._kind(spec) if plain else None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        if self.kind and isinstance(self.model, BPE):
            self.model._resize_cache(0)  # the model's own small cache hardly has what the tables do not hold
        self.tokenize = self.model.tokenize
        # Where the space stays with the word after it, few pieces are not such words.
        most = REMEMBERED // 4 if self.kind == "with space" else REMEMBERED
        self.plain = _Table(self._piece, most)
        self.following = _Table(self._following, REMEMBERED - REMEMBERED // 4)

    @staticmethod
    def _kind(spec: dict) -> str | None:
        before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not normal:
            return "with space"
        parts = before.get("pretokenizers") or [{}]
        steps = [x["type"] for x in (normal or {}).get("normalizers", [])]
        splits = parts[0].get("type") == "Split" and parts[0]["pattern"].get("Regex") == _WORD_PATTERN
        if splits and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and steps == ["NFC", "Replace", "Lowercase"]:
            return "without space"
        return None

    def _direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _core(self, core: str) -> bytes:
        """Ids of a single unit of the merges, by the model alone."""
        text = core.encode("utf-8").decode("latin-1").translate(_BYTES)
        return array("I", [token.id for token in self.tokenize(text)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not _SIMPLE.fullmatch(piece):
            return self._direct(piece)
        if self.kind == "with space":
            parts = _SIMPLE_WITH_SPACE.findall(piece)
        else:
            parts = _SIMPLE_WITHOUT_SPACE.findall(piece.lower())
        if parts == [piece]:
            return self._core(piece)
        return b"".join([self.following[part[1:]] if part[0] == " " else self.plain[part] for part in parts])

    def _following(self, word: str) -> bytes:
        """Ids of a word after a space; of one with a line feed before it, which stands in the space's place."""
        if word.isascii() and word.isalpha():  # bytes that print stand for themselves
            return array("I", [token.id for token in self.tokenize(_BYTES[0x20] + word)]).tobytes()
        if _LETTERS.fullmatch(word):
            return self._core(" " + word)
        own = word.removeprefix("\n")
        if own.split() != [own]:
            raise _OddSpace
        return self.plain["\n"] + self.plain[own] if word[0] == "\n" else self._piece(" " + word)

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = {"with space": self._with_space, "without space": self._without_space}.get(self.kind, self._direct)
        return [self._direct(text) if any(o in text for o in self.openings) else pieces(text) for text in texts]

    def _with_space(self, text: str) -> bytes:
        # If all white space is single spaces and line feeds, each between two words, every word is in the table of those.
        first, *words = text.replace("\n", " \n").split(" ")
        if first.split() == [first]:
            try:
                return self.plain[first] + b"".join(map(self.following.__getitem__, words))
            except _OddSpace:
                pass
        return b"".join(map(self.plain.__getitem__, _WITH_SPACE.findall(text)))

    def _without_space(self, text: str) -> bytes:
        odd = any(c in text for c in _SEPARATORS)
        return b"".join(map(self.plain.__getitem__, _WITHOUT_SPACE.findall(text) if odd else text.split()))


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder per file, meaning of special tokens and Python worker."""
    key = path, special_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
