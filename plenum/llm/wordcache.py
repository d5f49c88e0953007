"""Encoding of whole texts by public tokenizer files: byte-level models, and a cache of chunks."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The split pattern of the byte-level model, and what is left of it in texts where
#: no run of white space stands before a word (its look-ahead then decides nothing).
WHOLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
RUNS = re.compile(r"[^\S\x1c-\x1f]{2}[\S\x1c-\x1f]").search  # \x1c to \x1f are no white space there


SPACES = np.zeros(256, np.uint8)
SPACES[[9, 10, 11, 12, 13, 32]] = 1  # white space of one byte
SPACES[[0xC2, 0xE1, 0xE2, 0xE3]] = 2  # where white space of more bytes begins


def with_runs(texts: list[str]) -> list[bool]:
    """Which texts have a run of white space before a word; a look at bytes spares most the search."""
    kinds = SPACES[np.frombuffer("\0".join(texts).encode() + b"\0", np.uint8)]
    ends = np.cumsum([len(t.encode()) + 1 for t in texts])
    near = np.searchsorted(ends, np.flatnonzero((kinds[:-1] & kinds[1:] & 1) | (kinds[:-1] & 2)), "right")
    out = [False] * len(texts)
    for k in np.unique(near).tolist():
        out[k] = bool(RUNS(texts[k]))
    return out


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevelEncoder:
    """ids as little-endian unsigned 32-bit bytes, those of `tokenizers` for the file.

    The byte-pair merging is done by tiktoken over the file's own vocabulary (three times as
    fast, same ids). The first `verified` texts of every task, and all over the table those whose
    ids have a checksum that is a multiple of `share`, are encoded by both; a difference stops the
    task. Texts that hold a special token's string go to `tokenizers` itself.
    """

    def __init__(self, path: str, verified: int = 20, share: int = 512):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.left, self.share = Tokenizer.from_file(path), verified, share
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = [x["content"] for x in said["added_tokens"]]
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in self.special}
        self.whole, self.plain = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary for p in (WHOLE, PLAIN))

    def own(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t, r) for t, r in zip(texts, with_runs(texts))] if texts else []

    def encode(self, text: str, runs: bool) -> bytes:
        if any(s in text for s in self.special):
            return self.own(text)
        ids = array("I", (self.whole if runs else self.plain)(text)).tobytes()
        if self.left > 0 or not zlib.crc32(ids) % self.share:
            self.left -= 1
            if ids != self.own(text):
                raise ValueError("the merges of this file are not in the order of its ids")
        return ids


class ChunkEncoder:
    """The same over a cache of chunks, for models whose every chunk is encoded alike in any text.

    split: text to chunks; joinable: chunks that encode alike after any other; n_chars: length of
    each id's piece. The cache is cleared at `most` chunks, so memory is bounded.
    """

    def __init__(self, encode_batch, n_chars: np.ndarray, split, joinable, most: int = 400_000):
        self.encode_batch, self.n_chars, self.split, self.joinable, self.most, self.cache = encode_batch, n_chars, split, joinable, most, {}

    def learn(self, new: list[str], together: int) -> None:
        """Chunks to the cache, `together` encoded as one text where they may be.

        Where a chunk ends is found by the lengths of the pieces; a text whose ids do not end
        where its chunks do is encoded chunk by chunk.
        """
        groups = [new[at : at + together] for at in range(0, len(new), together)]
        for at in range(0, len(groups), 250):
            part = groups[at : at + 250]
            for chunks, got in zip(part, self.encode_batch(["".join(x) for x in part])):
                ids = np.array(got, "<u4")
                if together == 1:
                    self.cache[chunks[0]] = ids.tobytes()
                    continue
                ends, want = np.cumsum(self.n_chars[ids]), np.cumsum([len(c) for c in chunks])
                upto = np.searchsorted(ends, want) + 1
                if upto[-1] > len(ends) or not np.array_equal(ends[upto - 1], want) or len(ends) != upto[-1]:
                    self.learn(chunks, 1)
                    continue
                whole, begin = ids.tobytes(), 0
                for c, end in zip(chunks, (4 * upto).tolist()):
                    self.cache[c] = whole[begin:end]
                    begin = end

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.most:
            self.cache.clear()
        get, out = self.cache.get, []
        pieces = [self.split(t) for t in texts]
        found = [list(map(get, ps)) for ps in pieces]
        new = list({p for ps, got in zip(pieces, found) if None in got for p, g in zip(ps, got) if g is None})
        self.learn([c for c in new if not self.joinable(c)], 1)
        self.learn([c for c in new if self.joinable(c)], 200)
        for ps, got in zip(pieces, found):
            out.append(b"".join(map(self.cache.__getitem__, ps) if None in got else got))
        return out
