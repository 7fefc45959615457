"""Token ids by a tokenizer file, with words that were met before taken from bounded caches.

For a byte-level BPE file with word ends whose pre-tokenizer splits letters, single digits and other runs, Latin-1 texts take a
shorter way to the same ids: lower-case words split into pieces by the file's own rule, a piece's ids by a byte-pair merge over
the file's vocabulary (its ids rank its merges), both remembered. All other texts and files go through the tokenizer itself.
tests/llm/test_tokens.py holds both ways against each other.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

#: Words and pieces that a Python worker remembers (about 200 bytes each); beyond it the cache starts anew.
CACHE_WORDS = 200_000
_LOADED: dict[tuple, object] = {}
#: Controls and blanks on which splitting here and in tokenizers might differ, and beginnings of special tokens.
_ODD = re.compile("[\x1c-\x1f\x85\xa0]|<\\|")
#: The pattern of pre-tokenizers that the short way stands for.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")


def _byte_symbols() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """word -> its ids as bytes; made on the first look-up."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = self.make(word)
        return out


class _Encoder:
    def __init__(self, path: str, limit: int, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.short = self._short(spec, limit)
        self.long = _Words(self._whole, limit // 4)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _short(self, spec: dict, limit: int) -> _Words | None:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        split = [x.get("pattern", {}).get("Regex") for x in pre.get("pretokenizers", [])]
        names = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or _SPLIT not in split or names != ["NFC", "Replace", "Lowercase"]:
            return None
        import tiktoken

        # A word end is one more byte, 0xFF, which UTF-8 never has.
        symbols, special, ranks = _byte_symbols(), {x["id"] for x in spec.get("added_tokens", [])}, {}
        for token, i in model["vocab"].items():
            if i not in special:
                end = token.endswith("</w>") and len(token) > 4
                ranks[bytes(symbols[c] for c in (token[:-4] if end else token)) + b"\xff" * end] = i
        merge = tiktoken.Encoding("file", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        find = _PIECES.findall

        def make(word: str) -> bytes:
            pieces = find(word)
            if len(pieces) == 1:
                return array("I", merge(word.encode() + b"\xff")).tobytes()
            return b"".join(map(words.__getitem__, pieces))  # a piece is a word of one piece

        words = _Words(make, limit)
        return words

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if _ODD.search(text):
                out.append(self._whole(text))
                continue
            try:
                if self.short is None:
                    raise UnicodeError
                text.encode("latin-1")
                out.append(b"".join(map(self.short.__getitem__, text.lower().split())))
            except UnicodeError:
                out.append(b"".join(map(self.long.__getitem__, text.split())) if self.short is not None else self._whole(text))
        return out


class encoder:  # noqa: N801
    """A function from texts to their ids as little-endian unsigned 32-bit integers; no special tokens are added.

    ``plain``: strings of special tokens in a text are ordinary text. It travels as its arguments alone; the tokenizer and the
    caches load once for each Python worker.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS, plain: bool = False):
        self.key = (path, cache, plain)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.key not in _LOADED:
            _LOADED[self.key] = _Encoder(*self.key)
        return _LOADED[self.key](texts)
