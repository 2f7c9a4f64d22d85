"""Vectorised 64-bit hashes of words and of their parts, over many texts at once, without a Python object per word."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; the powers of the base are kept for so many places.
WINDOW = 1 << 20
_powers: list[np.ndarray] = []

#: A-Z to a-z, everything else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and ASCII punctuation becomes a space.
LOWER_WORDS = bytes(b + 32 if 65 <= b <= 90 else (b if b > 127 or chr(b).isalnum() else 32) for b in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        m = max(n + 1, WINDOW + 1)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(m, np.uint64(base))
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        if m > 4 * WINDOW:
            return out
        _powers[:] = out
    return _powers


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of the bytes from each start to its end; starts ascend."""
    out, done = np.empty(len(start), np.uint64), 0
    while done < len(start):
        origin = int(start[done])
        upto = max(done + 1, int(np.searchsorted(end, origin + WINDOW, "right")))
        s, e = start[done:upto] - origin, end[done:upto] - origin
        last = int(e.max(initial=0))
        power, inverse = _power_tables(last + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(last + 1, np.uint64)
            np.cumsum((data[origin : origin + last].astype(np.uint64) + np.uint64(1)) * power[:last], out=total[1:])
            h = (total[e] - total[s]) * inverse[s]
            out[done:upto] = mix(h ^ mix((e - s).astype(np.uint64) + np.uint64(salt * 1_000_003)))
        done = upto
    return out


class Words:
    """The words of some texts: `doc` has each word's text, `start` and `end` its bytes in `raw`."""

    def __init__(self, texts, table: bytes = LOWER):
        parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.n_docs = len(parts)
        self.raw = (b" ".join(parts) + b" ").translate(table)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        space = _IS_SPACE[self.bytes]
        word = ~space
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.begins, self.start, "right") - 1
        self.counts = np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
        """A hash of the bytes from each start to its end (by default of each word)."""
        return hash_spans(self.bytes, self.start if start is None else start, self.end if end is None else end, salt)

    def slices(self):
        """(from, to) of each text's words."""
        ends = np.cumsum(self.counts)
        return zip(ends - self.counts, ends, strict=True)


def shingle_sets(texts, k: int = 5) -> list[np.ndarray]:
    """The distinct hashes of runs of k words of each text, sorted; of a shorter text all its words as one run."""
    words = Words(texts)
    h = words.hashes()
    n = len(h)
    runs = h.copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            if n > j:
                runs[: n - j] = mix(runs[: n - j] * np.uint64(3) + h[j:])
    out = []
    for a, b in words.slices():
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    one = mix(one * np.uint64(5) + x)
            out.append(np.asarray([one], np.uint64).reshape(-1))
        else:
            out.append(np.empty(0, np.uint64))
    return out
