"""Token ids by the tokenizers library, each distinct piece of text encoded once.

A text is cut where no token can run across: in front of white space that
follows a visible character, and behind a Latin letter that a byte other than a
letter follows.  (Both tokenizers used here split there before they merge, and
neither looks back.)  The pieces are hashed, the distinct new ones are encoded
by the library, and a bounded cache that lives as long as the Python worker has
the rest.  The ids equal those of the whole text.

Special token strings in a text are ordinary text, or with ``special`` the
tokens that the library by default finds in them: pieces of their own.  Null is
the empty text, which has no ids.
"""

from __future__ import annotations

import os
import re

import numpy as np
from pyspark.sql import SparkSession

from ctxloom.llm.textops import flat, hash_spans

#: Pieces that a worker's cache may hold before it starts anew.
CACHE = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[0x41:0x5B] = _ALPHA[0x61:0x7B] = True


def cuts(buf: np.ndarray, n: int) -> np.ndarray:
    """Flags of the first byte of each piece (the first of a row not included)."""
    out = np.zeros(n, bool)
    if n < 2:
        return out
    cur, prev = buf[1:n], buf[:n - 1]
    space = _SPACE[cur]
    out[1:] = (space & _VISIBLE[prev]) | (_ALPHA[prev] & ~_ALPHA[cur] & (cur < 0x80))
    # behind a character beyond ASCII: its last bytes tell letters and white space
    at = np.flatnonzero((prev >= 0x80) & (cur < 0x80) & ~_ALPHA[cur]) + 1
    if len(at):
        b1, b2 = buf[at - 1], np.where(at >= 2, buf[np.maximum(at - 2, 0)], 0)
        b3 = np.where(at >= 3, buf[np.maximum(at - 3, 0)], 0)
        letter = (b2 == 0xC3) & (b1 != 0x97) & (b1 != 0xB7)
        blank = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)
                 | (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))
                 | (b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F) | (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))
        out[at] = letter | (_SPACE[buf[at]] & ~blank)
    return out


class Encoder:
    """Encodes batches of texts; holds the ids of pieces seen."""

    def __init__(self, spec: bytes, cache: int = CACHE, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(spec)
        self.tokenizer.encode_special_tokens = not special
        found = self.tokenizer.get_added_tokens_decoder().values() if special else ()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in found):
            raise ValueError("added tokens that are not found as plain strings")
        self.literals = sorted((t.content.encode() for t in found if t.content), key=len, reverse=True)
        self.literal = re.compile(b"|".join(map(re.escape, self.literals)))
        self.limit = cache
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # ascending hashes, and where their ids are
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        sizes = np.zeros(len(pieces), np.int64)
        start = self.used
        for k in range(0, len(pieces), 4096):  # the library's results are large
            some = self.tokenizer.encode_batch_fast([p.decode() for p in pieces[k:k + 4096]], add_special_tokens=False)
            ids = [e.ids for e in some]
            sizes[k:k + len(ids)] = [len(i) for i in ids]
            new = np.fromiter((x for i in ids for x in i), np.uint32)
            while self.used + len(new) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.uint32)))
            self.pool[self.used:self.used + len(new)] = new
            self.used += len(new)
        place = np.searchsorted(self.known, hashes)
        self.at = np.insert(self.at, place, start + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, place, sizes)
        self.known = np.insert(self.known, place, hashes)

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row offsets) of a string column of bounded size."""
        buf, offs = flat(col)
        n = int(offs[-1])
        first = cuts(buf, n)
        first[offs[:-1][offs[1:] > offs[:-1]]] = True
        body = None
        if self.literals and any(x in (body := buf.tobytes()) for x in self.literals):
            for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False):
                for m in self.literal.finditer(body, a, b):
                    first[m.start():m.end()] = False
                    first[m.start()] = True
                    first[m.end():m.end() + 1] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)[:len(starts)]
        hashes, where, inverse = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > self.limit:
            self._clear()
        near = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = near < len(self.known)
        new[inside] = self.known[near[inside]] != hashes[inside]
        if new.any():
            body = body or buf.tobytes()
            self._learn(hashes[new], [body[starts[i]:ends[i]] for i in where[new].tolist()])
            near = np.searchsorted(self.known, hashes)
        size = self.size[near][inverse]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(self.at[near][inverse] - total[:-1], size) + np.arange(int(total[-1]))]
        return ids, total[np.searchsorted(starts, offs)]


_ENCODERS: dict[tuple[int, bool], Encoder] = {}


def encoder(sent, special: bool = False) -> Encoder:
    """The worker's encoder of a broadcast tokenizer file."""
    spec = sent.value
    key = hash(spec), special
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, special=special)
    return _ENCODERS[key]


def send(spark: SparkSession, path: str):
    """Broadcast of a tokenizer file (a few MB, whatever the corpus)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def with_end(ids: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The id ``end`` behind each row."""
    out = np.insert(ids, offs[1:], np.uint32(end)) if len(offs) > 1 else ids
    return out.astype(np.uint32, copy=False), offs + np.arange(len(offs))
