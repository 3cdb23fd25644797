"""A byte-level BPE vocabulary inside a task: pre-tokens, piece ids and bytes.

A *pre-token* here is a stretch of text that ends before a single space with
text on both sides. The split pattern of a byte-level vocabulary always starts
a new piece there, so the ids of a text are the ids of its pre-tokens one after
the other, and a pre-token seen before need not be encoded again.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: Distinct pre-tokens a task remembers before it starts afresh, which bounds its memory.
REMEMBERED = 300_000


def pre_tokens(text: str) -> list[str]:
    """Cut before every single space that has text on both sides.

    The library's own encoding of the parts, put together, is that of the text:
    a special string with a space in it would break this, see ``Vocabulary``.
    """
    words = text.split(" ")
    if len(words) == 1:
        return [text] if text else []
    out = [words[0]]
    for word in words[1:]:
        last = out[-1]
        if word and last and not word[0].isspace() and not last[-1].isspace():
            out.append(" " + word)
        else:
            out[-1] = last + " " + word
    return out


class Vocabulary:
    """A loaded tokenizer file; one per worker process, see ``vocabulary``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.specials = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special_ids = {self.tokenizer.token_to_id(s) for s in self.specials}
        if any(" " in s for s in self.specials):
            raise ValueError("a special string with a space in it cannot be cut at spaces")
        size = self.tokenizer.get_vocab_size()
        self.pieces = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.decimal = [str(i) for i in range(size)]
        back = {c: b for b, c in enumerate(byte_letters())}
        special = set(self.specials)
        self.bytes = [
            p.encode() if p in special or any(c not in back for c in p) else bytes(back[c] for c in p)
            for p in self.pieces
        ]
        self._known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids for e in found]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; each distinct pre-token is encoded once."""
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        cut = [pre_tokens(t) for t in texts]
        new = list({p for parts in cut for p in parts if p not in known})
        for start in range(0, len(new), 4096):
            some = new[start : start + 4096]
            for part, ids in zip(some, self.encode(some), strict=True):
                known[part] = np.array(ids, np.uint32).tobytes()
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, parts)), np.uint32) for parts in cut]

    def forget(self) -> None:
        """Drop the pre-tokens remembered, at the end of a task."""
        self._known = {}

    def count(self, parts: list[str]) -> list[int]:
        """Number of pieces of each pre-token."""
        return [len(ids) for ids in self.encode(parts)]

    def joined(self, ids: np.ndarray) -> str:
        """Decimal ids, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others are numbered from U+0100.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]
