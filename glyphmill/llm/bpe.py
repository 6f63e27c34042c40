"""Byte-level BPE in batched numpy merge rounds.

All distinct words of a batch lie one after another in a flat array of symbols. Each round looks every neighbouring pair up by
binary search in the sorted keys of all merges, takes the lowest rank of each word and merges its places at once, until no word has a pair left.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the pattern that cuts text into words, as the tokenizer's publisher gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_DIR = "/opt/tokenizers"
NO_RANK = np.int32(2**31 - 1)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 as itself, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class BatchBPE:
    """Encodes texts with a vocabulary file of the kind byte-level BPE with explicit merges."""

    def __init__(self, path: str, keep: int = 200_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = _byte_letters()
        self.byte_ids = np.zeros(256, np.int32)
        for ch, b in letters.items():
            self.byte_ids[b] = vocab[ch]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        self.split = regex.compile(PATTERN)
        self.known: dict[str, np.ndarray] = {}
        self.keep = keep

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; words are merged together, round by round."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        own = np.repeat(np.arange(len(words)), size)
        while len(sym):
            last = np.append(own[1:] != own[:-1], True)
            key = sym.astype(np.int64) << 32
            key[:-1] |= sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & ~last, self.rank[at], NO_RANK)
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            least = np.minimum.reduceat(rank, begin)
            n = np.diff(np.append(begin, len(sym)))
            least_of = np.repeat(least, n)
            done = least == NO_RANK
            if done.any():
                for k in np.flatnonzero(done):
                    out[own[begin[k]]] = sym[begin[k] : begin[k] + n[k]]
                stay = np.repeat(~done, n)
                sym, own, rank, least_of = sym[stay], own[stay], rank[stay], least_of[stay]
                if not len(sym):
                    break
            hit = rank == least_of
            # in a row of hits that follow each other (one symbol repeated) every second one merges
            if (hit[1:] & hit[:-1]).any():
                place = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
                hit &= (place - run) % 2 == 0
            sym = sym.copy()
            sym[hit] = self.made[least_of[hit]]
            stay = ~np.append(False, hit[:-1])
            sym, own = sym[stay], own[stay]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the place where each text's ids end. Null and empty texts have none."""
        cut = [self.split.findall(t) if t else [] for t in texts]
        new = {w for ws in cut for w in ws if w not in self.known}
        if len(self.known) + len(new) > self.keep:
            self.known = {}
            new = {w for ws in cut for w in ws}
        if new:
            fresh = list(new)
            self.known.update(zip(fresh, self.merge([w.encode("utf-8", "surrogatepass") for w in fresh])))
        known = self.known
        parts = [known[w] for ws in cut for w in ws]
        flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends_of_words = np.concatenate([[0], np.cumsum(sizes)])
        return flat, ends_of_words[np.cumsum([len(ws) for ws in cut])] if texts else np.empty(0, np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> BatchBPE:
    """One encoder per worker process and file."""
    return BatchBPE(path)


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """Path of a vocabulary file; the folder is a parameter, GLYPHMILL_TOKENIZERS in the environment, or the usual place."""
    return os.path.join(folder or os.environ.get("GLYPHMILL_TOKENIZERS", DEFAULT_DIR), f"{name}.json")
