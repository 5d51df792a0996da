"""Token ids of whole texts with the tokenizers library, chunk by chunk.

A text is cut only where no token can cross: at white space that the tokenizer drops, or before a single blank between
two other characters that the tokenizer glues to what follows. Equal chunks of a slice are encoded once, and chunks met
before come from a bounded memo, so the ids are those of encoding the whole text.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from furnacelens.llm.words import BASE, BYTE_VALUES, NON_SPACE, U, mix, powers, split, texts

MEMO = 600_000  # chunks kept by a worker process: about 30 MB, with spans 50 MB
JOINED = 128  # strings encoded as one
# what stands between them, its id being that of nothing else: a word of its own, or a token added to the vocabulary
WORD_JOINT, TOKEN_JOINT = " \x01 ", "\U0010FFFD\U0010FFFC"
GLUED, DROPPED = "glued", "dropped"  # what the tokenizer does with a blank before a word


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Ids (and spans) of chunks met before, by hash and length, in flat arrays; what comes once it is full is not kept."""

    def __init__(self, dtype, spans: bool) -> None:
        self.hash, self.length, self.begin, self.size = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.spans = np.zeros(1 << 16, dtype), np.zeros((1 << 16, 2), np.int32) if spans else None
        self.used = 0

    def find(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Place of each sorted hash, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where((self.hash[at] == h) & (self.length[at] == length), at, -1)

    def add(self, h: np.ndarray, length: np.ndarray, size: np.ndarray, ids: np.ndarray, spans: np.ndarray | None) -> None:
        """Chunks by ascending hash."""
        end = self.used + len(ids)
        if end > len(self.ids):
            grown = max(end, 2 * len(self.ids))
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(grown - self.used, self.ids.dtype)])
            if spans is not None:
                self.spans = np.concatenate([self.spans[: self.used], np.zeros((grown - self.used, 2), np.int32)])
        self.ids[self.used : end] = ids
        if spans is not None:
            self.spans[self.used : end] = spans
        at = np.searchsorted(self.hash, h)
        begin = self.used + np.cumsum(size) - size
        self.hash, self.length = np.insert(self.hash, at, h), np.insert(self.length, at, length)
        self.begin, self.size = np.insert(self.begin, at, begin), np.insert(self.size, at, size)
        self.used = end


class Encoder:
    def __init__(self, path: str, blank: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.blank = blank
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.memo = {spans: Memo(self.dtype, spans) for spans in (False, True)}
        self.joined, self.joint = self.tokenizer, WORD_JOINT
        ids = self.tokenizer.encode(WORD_JOINT, add_special_tokens=False).ids
        if blank != DROPPED or len(ids) != 1:
            # the library splits a text at added tokens before anything else
            self.joined, self.joint = Tokenizer.from_file(path), TOKEN_JOINT
            self.joined.encode_special_tokens = True
            self.joined.add_tokens([AddedToken(TOKEN_JOINT, normalized=False, special=False)])
            ids = [self.joined.token_to_id(TOKEN_JOINT)]
        self.joint_id = ids[0]

    def encode(self, strings: list[str], spans: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(number of ids of each string, all ids, with spans their character starts and ends)."""
        if not spans and not any(self.joint.strip() in s for s in strings):
            whole = [self.joint.join(strings[i : i + JOINED]) + self.joint for i in range(0, len(strings), JOINED)]
            found = [np.array(e.ids, np.uint32) for i in range(0, len(whole), 64) for e in self.joined.encode_batch_fast(whole[i : i + 64], add_special_tokens=False)]
            flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
            ends = flat == self.joint_id
            return np.diff(np.flatnonzero(ends), prepend=-1) - 1, flat[~ends].astype(self.dtype), None
        encode = self.tokenizer.encode_batch if spans else self.tokenizer.encode_batch_fast
        ids, places = [np.zeros(0, self.dtype)], [np.zeros((0, 2), np.int32)]
        for i in range(0, len(strings), 512):
            for e in encode(strings[i : i + 512], add_special_tokens=False):
                ids.append(np.array(e.ids, self.dtype))
                if spans:
                    places.append(np.array(e.offsets, np.int32).reshape(-1, 2))
        return np.array([len(x) for x in ids[1:]], np.int64), np.concatenate(ids), np.concatenate(places) if spans else None


@lru_cache(4)
def encoder(path: str, blank: str) -> Encoder:
    return Encoder(path, blank)


@dataclass
class Encoded:
    ids: np.ndarray
    first: np.ndarray  # of each row, its first id; one more at the end
    spans: np.ndarray | None  # (start, end) in code points of the row


def _wide_space(d: np.ndarray) -> np.ndarray:
    """Flags bytes of white space outside ASCII, and the separators 1C to 1F."""
    out = (d >= 0x1C) & (d <= 0x1F)
    at = np.flatnonzero(d[:-1] == 0xC2)
    at = at[(d[at + 1] == 0xA0) | (d[at + 1] == 0x85)]
    out[at] = out[at + 1] = True
    for lead in (0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(d[:-2] == lead)
        two, three = d[at + 1], d[at + 2]
        if lead == 0xE1:
            hit = (two == 0x9A) & (three == 0x80)
        elif lead == 0xE3:
            hit = (two == 0x80) & (three == 0x80)
        else:
            hit = (two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F)
        for j in range(3):
            out[at[hit] + j] = True
    return out


def chunks(column: pa.Array, blank: str):
    """(bytes, offsets of rows, starts, ends of chunks, first chunk of each row, hash of each chunk)."""
    if blank == DROPPED:
        w = split(column, NON_SPACE)
        return w.data, w.offsets, w.starts, w.ends, w.first, w.hash
    data, off = texts(column)
    n = len(data)
    space = ~NON_SPACE[data] | _wide_space(data) if n > 2 else np.ones(n, bool)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        cut[1 : n - 1] = (data[1:-1] == 32) & ~space[:-2] & ~space[2:]
    # the neighbours must be of the same row
    cut[off] = False
    last = off[1:] - 1
    cut[last[last >= 0]] = False
    edge = off[:-1][np.diff(off) > 0]
    cut[edge] = True
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts[1:], n) if len(starts) else starts
    up, down = powers(BASE, n + 1)
    c = np.zeros(n + 1, U)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=c[1:])
    return data, off, starts, ends, np.searchsorted(starts, off), mix((c[ends] - c[starts]) * down[starts])


def encode(column: pa.Array, path: str, blank: str, spans: bool = False) -> Encoded:
    """Ids of every row of a text column."""
    enc = encoder(path, blank)
    data, off, starts, ends, first, h = chunks(column, blank)
    h, at, which = np.unique(h, return_index=True, return_inverse=True)
    starts_at, length = starts[at], ends[at] - starts[at]
    memo = enc.memo[spans]
    place = memo.find(h, length)
    new = np.flatnonzero(place < 0)
    raw = data.tobytes()
    sizes, ids, where = enc.encode([raw[i : i + n].decode() for i, n in zip(starts_at[new].tolist(), length[new].tolist())], spans)
    size, begin = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    kept = place >= 0
    if kept.any():
        size[kept], begin[kept] = memo.size[place[kept]], memo.begin[place[kept]]
    size[new], begin[new] = sizes, memo.used + np.cumsum(sizes) - sizes
    pool = np.concatenate([memo.ids[: memo.used], ids])
    rel = np.concatenate([memo.spans[: memo.used], where]) if spans else None
    room = min(len(new), MEMO - len(memo.hash))
    if room > 0:
        few, n = new[:room], sizes[:room].sum()
        memo.add(h[few], length[few], sizes[:room], ids[:n], where[:n] if spans else None)
    n = size[which]
    to = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    take = np.repeat(begin[which] - to[:-1], n) + np.arange(to[-1])
    out = Encoded(pool[take], to[first], None)
    if spans:
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        base = chars[starts] - chars[off[row]]
        out.spans = rel[take] + np.repeat(base, n)[:, None]
    return out
