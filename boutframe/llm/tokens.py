"""Token ids of whole texts as the ``tokenizers`` library gives them, each word encoded once.

A byte-level BPE splits a text into pieces by a fixed pattern and encodes every piece on its own.
For texts of common letters the pattern is applied here, and only pieces that the worker has not
met yet go through the library; every other text goes through it whole. Both ways give the same
ids, which the tests compare.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from boutframe.llm.tables import runs

#: Pieces a worker learns before it lets go of those not met since it last did so; it remembers twice
#: as many and those of a run at most. Bounds memory, not results.
REMEMBERED = 200_000
#: Texts are split in runs of about so many characters, as a piece takes far more memory than its text.
RUN_CHARS = 200_000

# Letters whose class no version of Unicode disputes; other texts take the library's own split.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_UNUSUAL = re.compile(f"[^\t\n\r\x20-\x7e{_LETTERS}]")
# FIXED VALUE: the byte-level split pattern, for these letters.
_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_SPACED_WORD = re.compile(f" [{_LETTERS}]+")


def tokenizer_digest(definition: str) -> str:
    """Names a tokenizer's version: its whole definition and the library that reads it."""
    import tokenizers

    return hashlib.sha256(f"{tokenizers.__version__}\n{definition}".encode()).hexdigest()


@lru_cache(maxsize=2)
def encoder(definition: str) -> Encoder:
    # A task has a core; the library's threads would each keep memory of their own.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(definition)


class Encoder:
    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(definition)
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space", True)
            and not spec.get("normalizer")
            and spec["model"].get("type") == "BPE"
            and not spec["model"].get("dropout")
        )
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(added)) if added else None
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return list(chain.from_iterable(map(self._ids, runs(texts, RUN_CHARS))))

    def _ids(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_piece and not _UNUSUAL.search(t) and not (self.added and self.added.search(t)) for t in texts]
        pieces = [_PIECES.findall(t) if p else () for t, p in zip(texts, plain)]
        self._learn(set(chain.from_iterable(pieces)))
        whole = iter(self._whole([t for t, p in zip(texts, plain) if not p]))
        return [b"".join(map(self.known.__getitem__, ws)) if p else next(whole) for ws, p in zip(pieces, plain)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.earlier, self.known = self.known, {}
        missing = pieces.difference(self.known)
        again = {p: self.earlier[p] for p in missing if p in self.earlier}
        self.known.update(again)
        missing.difference_update(again)
        spaced = [p for p in missing if _SPACED_WORD.fullmatch(p)]
        for k in range(0, len(spaced), 10_000):
            # Words that begin with a space stay apart when put together.
            words = spaced[k : k + 10_000]
            e = self.tokenizer.encode("".join(words), add_special_tokens=False)
            ids, of = np.array(e.ids, "<u4"), np.array(e.word_ids)
            ends = np.searchsorted(of, np.arange(len(words)), side="right")
            for word, a, b in zip(words, [0, *ends[:-1]], ends):
                self.known[word] = ids[a:b].tobytes()
        other = [p for p in missing if p not in self.known]
        self.known.update(zip(other, self._whole(other)))
