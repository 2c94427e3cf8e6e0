"""Words, shingles and lines of a batch of texts as arrays over the texts' UTF-8 bytes; words are [^\\x20\\x09-\\x0D]+."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import mix, span_hashes

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of each text of a string column; null texts have none."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_string())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        body = column.buffers()[2]
        self.data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.n_docs = n
        size = len(self.data)
        self.white = WHITE[self.data]
        edge = np.zeros(size + 1, bool)
        edge[self.offsets] = True
        start, stop = ~self.white, ~self.white
        start[1:] &= self.white[:-1] | edge[1:size]
        stop[:-1] &= self.white[1:] | edge[1:size]
        self.starts = np.flatnonzero(start)
        self.lengths = np.flatnonzero(stop) + 1 - self.starts
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text, its first word
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value for each byte over the texts."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self, lower: bool) -> np.ndarray:
        return span_hashes(LOWER[self.data] if lower else self.data, self.starts, self.lengths)

    def windows(self, hashes: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each window of `size` words inside a text."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h = mix(h + hashes[at + k])
        return at, h

    def shingle_sets(self, size: int = 3) -> list[np.ndarray]:
        """The sorted set of hashes of each text's lower-cased shingles; a text with fewer words is one shingle, one without words none."""
        hashes = self.hashes(lower=True)
        at, h = self.windows(hashes, size)
        bounds = np.searchsorted(self.doc[at], np.arange(self.n_docs + 1))
        out = []
        for i in range(self.n_docs):
            a, b = bounds[i], bounds[i + 1]
            if b - a:
                s = np.sort(h[a:b])
                new = np.ones(b - a, bool)
                np.not_equal(s[1:], s[:-1], out=new[1:])
                out.append(s[new])
            elif self.counts[i]:
                one = np.full(1, self.counts[i], np.uint64)
                for k in range(self.first[i], self.first[i + 1]):
                    one = mix(one + hashes[k : k + 1])
                out.append(one)
            else:
                out.append(np.empty(0, np.uint64))
        return out

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each \\n-split line that holds a word: its text, start, end and first word."""
        size = len(self.data)
        cut = np.zeros(size + 1, bool)
        cut[self.offsets] = True
        breaks = np.flatnonzero(self.data == 10)
        cut[breaks + 1] = True
        begin = np.flatnonzero(cut)
        line_of_word = np.searchsorted(begin, self.starts, "right") - 1
        new = np.flatnonzero(np.r_[True, line_of_word[1:] != line_of_word[:-1]]) if len(line_of_word) else np.empty(0, np.int64)
        line = line_of_word[new]
        start = begin[line]
        following = begin[np.minimum(line + 1, len(begin) - 1)]
        ends_by_break = (following > start) & (self.data[following - 1] == 10) if len(line) else np.empty(0, bool)
        return self.doc[new], start, following - ends_by_break, new
