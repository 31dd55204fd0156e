"""Encoding with a public tokenizer's file, one library call for each distinct pretoken."""

from __future__ import annotations

import os
import re

import numpy as np
import regex

from framewright.llm.base import held

#: The split patterns of the two public vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters on which Python's and the library's classes and case folding surely agree.
UNSURE = re.compile("[^\t\n\r -~¡-įı-ɏ]")


def _sure_class(kind: str) -> str:
    """The characters of a Unicode class among the proven ones and their lower-case forms, as ranges of a set."""
    proven = {c for c in map(chr, range(0x250)) if not UNSURE.match(c)}
    own = sorted(ord(c) for c in proven | {c.lower() for c in proven} if regex.match(kind, c))
    starts = [c for c in own if c - 1 not in own]
    stops = [c for c in own if c + 1 not in own]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, stops, strict=True))


def sure_pattern(pattern: str) -> re.Pattern:
    """``pattern`` for texts of proven characters: explicit sets instead of Unicode classes, which split in half the time."""
    letters, numbers = _sure_class(r"\p{L}"), _sure_class(r"\p{N}")
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letters}{numbers}]")
    for kind, own in ((r"\p{L}", letters), (r"\p{N}", numbers)):
        plain = plain.replace(f"[{kind}]", kind).replace(kind, f"[{own}]")
    return re.compile(plain)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Token ids of whole texts, equal to the library's, as little-endian 32-bit bytes.

    The text is split with the vocabulary's own pattern; each distinct pretoken goes through the
    library's model once and is then kept, up to ``most`` pretokens, after which the memory starts
    anew. Texts with characters outside a proven range, or with the string of an added token (which the
    library makes one id by default), go through the library as a whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        added = self.whole.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not t.normalized]
        folded = [re.escape(t.content) for t in added if t.normalized]  # these are looked for after case folding
        self.folded = re.compile("|".join(folded), re.IGNORECASE) if folded else None
        self.model, self.most = self.whole.model, most
        self.lower = self.whole.normalizer is not None
        self.split = sure_pattern(WORD_PATTERN if self.lower else BYTE_PATTERN).findall
        self.letters = [_byte_letters()[b] for b in range(256)]

    def __missing__(self, pretoken: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        letters = self.letters
        found = self.model.tokenize("".join([letters[b] for b in pretoken.encode()]))
        ids = np.array([t.id for t in found], "<u4").tobytes()
        self[pretoken] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if UNSURE.search(text) or any(t in text for t in self.added) or (self.folded and self.folded.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, self.split(text.lower() if self.lower else text)))


def encoder(path: str, most: int = 400_000) -> Encoder:
    """The worker's encoder of a file, until it needs another large object."""
    return held("encoder", (path, most), lambda: Encoder(path, most))
