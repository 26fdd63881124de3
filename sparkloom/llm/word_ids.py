"""Token ids of a lower-casing BPE with word ends (a tokenizers file), fast on whole corpora.

White space separates words for good in this kind of tokenizer, so the ids of a text are the ids of its words in a
row. Words are looked up in a bounded cache; a new word of Latin letters is merged by rank with the byte-level BPE of
tiktoken, built from the same file; anything unusual goes to tokenizers itself. Ids equal those of tokenizers.
"""

from __future__ import annotations

import json
import os
import struct

import regex
import tiktoken

#: Most words that a worker keeps, and bytes of a word that is kept; further words are computed each time.
MOST_WORDS, KEPT_BYTES = 400_000, 64


def _byte_chars() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """Maps a word (UTF-8 bytes without ASCII white space) to its ids as little-endian unsigned 32-bit bytes."""

    END = "</w>"

    def __init__(self, path: str, most: int = MOST_WORDS) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.most = most
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # marks inside a text are ordinary text
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        self.simple = regex.compile(r"[!-~¡-įı-ſ]+")
        model = spec["model"]
        chars = _byte_chars()
        back = {c: b for b, c in chars.items()}
        # A word end is the byte 0xFF, which UTF-8 never has; its joining to the last byte comes before all merges.
        ranks = {bytes([b]): b for b in range(256)}
        ids: list[int | None] = [model["vocab"].get(chars[b]) for b in range(256)]
        for b in range(256):
            ranks[bytes([b, 255])] = len(ids)
            ids.append(model["vocab"].get(chars[b] + self.END))
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ended = right.endswith(self.END) and len(right) >= len(self.END)
            core = left + (right[: -len(self.END)] if ended else right)
            ranks[bytes(back[c] for c in core) + b"\xff" * ended] = len(ids)
            ids.append(model["vocab"][left + right])
        self.ids = [None if i is None else struct.pack("<I", i) for i in ids]
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        found = self._ids(word)
        if len(self) < self.most and len(word) <= KEPT_BYTES:
            self[word] = found
        return found

    def _ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if self.simple.fullmatch(text):
            low = text.lower()
            if low.isalpha():
                if low != text:
                    return self[low.encode()]
                return b"".join([self.ids[i] for i in self.merge(word + b"\xff")])
            parts = self.pieces.findall(low)
            if len(parts) > 1:
                return b"".join([self[p.encode()] for p in parts])
        got = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(got)}I", *got)

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text."""
        return b"".join(map(self.__getitem__, text.split()))


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One instance for each file in a Python process."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
