"""Word-wise BPE with word ends: each distinct word is merged once and remembered."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from struct import pack

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Bytes, about, of the words that a worker remembers, and what an entry takes besides its characters and ids.
REMEMBER, ENTRY = 24 << 20, 200
#: Characters whose case and class are the same in all of the libraries; other texts take the library's own way.
_COMMON = [c for c in (*range(0x180), *range(0x2010, 0x2028), 0x20AC) if c not in range(0x1C, 0x20)]
#: End of a word; no UTF-8 text has this byte.
_END = b"\xff"
_loaded: dict[str, WordBpe] = {}


def _characters(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in _COMMON if unicodedata.category(chr(c))[0] == kind)


_SPACE = "\t-\r \x85\xa0"
_OTHER_TEXT = re.compile("[^" + "".join(re.escape(chr(c)) for c in _COMMON) + "]")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_characters('L')}]+|[{_characters('N')}]|[^{_SPACE}{_characters('L')}{_characters('N')}]+")


def _byte_of() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """The ids of each run of characters between white space, as little-endian unsigned 32-bit integers."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.size = merge, 0

    def __missing__(self, run: str) -> bytes:
        if self.size >= REMEMBER:
            self.clear()
            self.size = 0
        ids: list[int] = []
        for word in _WORD.findall(run):
            ids += self.merge(word.encode() + _END)
        found = pack(f"<{len(ids)}I", *ids)
        if len(run) < 64:
            self[run] = found
            self.size += ENTRY + len(run) + len(found)
        return found


class WordBpe:
    """Ids of the vocabulary file at path, as its library gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = _byte_of()
        ranks = {}
        for token, i in vocabulary.items():
            stem = token.removesuffix("</w>")
            if all(c in byte for c in stem):
                ranks[bytes(byte[c] for c in stem) + _END * (stem != token)] = i
        self.words = _Words(tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece)

    @staticmethod
    def load(path: str) -> WordBpe:
        if path not in _loaded:
            _loaded[path] = WordBpe(path)
        return _loaded[path]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if _OTHER_TEXT.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.lower()
        get, out, at = self.words.__getitem__, [], 0
        while at < len(text):
            end = at + (1 << 20)
            if end < len(text):
                space = text.find(" ", end)
                end = space if space >= 0 else len(text)
            out.append(b"".join(map(get, text[at:end].split())))
            at = end
        return b"".join(out)
