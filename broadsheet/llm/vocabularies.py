"""Ids by public vocabulary files, one loaded copy per worker and file.

A byte-level vocabulary in a `tokenizers` file is run by tiktoken where both give the same
ids (its merges are numbered in order, which is checked) and by `tokenizers` itself for
texts that hold a special token's string or white space without end, on which tiktoken's
pattern overflows.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  #: of the byte-level format
_BLANK = re.compile(r"\s{1000}")


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: visible bytes stand for themselves, others follow U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def token_bytes(entry: str) -> bytes:
    alphabet = byte_alphabet()
    return bytes(alphabet[c] for c in entry)


class ByteLevel:
    """A byte-level BPE file; `plain` takes special tokens' strings as text."""

    def __init__(self, path: str, plain: bool):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = plain
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, merges = content["model"]["vocab"], content["model"]["merges"]
        special = [t["content"] for t in content["added_tokens"]]
        self.special = [] if plain else special
        self.tokens = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in content["added_tokens"])]))
        for entry, i in vocabulary.items():
            self.tokens[i] = token_bytes(entry)
        in_order = all(vocabulary["".join(m)] == 256 + i for i, m in enumerate(merges))
        as_known = content["normalizer"] is None and content["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = tiktoken.Encoding("file", pat_str=_PATTERN, special_tokens={},
                                      mergeable_ranks={self.tokens[i]: i for i in vocabulary.values()}) if in_order and as_known else None

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for text in texts:
            if self.fast is None or any(s in text for s in self.special) or _BLANK.search(text):
                yield np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                yield self.fast.encode_to_numpy(text, disallowed_special=())


@functools.cache
def byte_level(path: str, plain: bool = False) -> ByteLevel:
    return ByteLevel(path, plain)


@functools.cache
def sentence_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_bytes(path: str) -> list[bytes]:
    """Bytes of each piece: U+2581 is a space, <0xHH> a byte."""
    model = sentence_pieces(path)
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
