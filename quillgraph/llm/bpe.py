"""Byte pair encoding on ragged numpy arrays.

`Vocabulary` holds the merge table of a tokenizer file. Two encoders work on batches of words:

* `merge_synchronously`: in every round each word applies its lowest-ranked pair, all words at once.
* `speculate`: greedy longest match proposes tokens, every adjacent pair is tested for compatibility, and only words
  that fail a test are merged exactly.

A pair of tokens (a, b) is compatible if merging the string ab never joins them. a's right edge and b's left edge pass
through the nodes of their merge trees; going back in time from (a, b), the younger of both is undone first, which visits
every pair (x, y) that ever lay side by side. A merge of rank m joins x and y if it comes before x is used up (rank of x's
parent) and not after y is (equal ranks: the left pair goes first). A sequence of valid tokens whose adjacent pairs are all
compatible is what exact merging yields.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import regex

from .shared import HEADS, eights, gather, span_hashes

#: White space as the tokenizer files' regular expressions take it (Unicode White_Space).
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
NEVER = np.int32(2**31 - 1)
#: Words of up to so many symbols are merged together; a place in one of them takes _PLACE bits beside a rank.
SHORT = np.array([10, 16, 30])
_PLACE = 5
_IDLE = np.int32(2**31 - (1 << _PLACE))


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class PairTable:
    """(left, right) -> number, by open addressing in two numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray, bits: int = 18):
        while (1 << bits) < 4 * len(left):
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int32)
        pending = (left.astype(np.int64) << 32) | right
        at, held = self._slot(pending), value.astype(np.int32)
        while len(pending):
            free = self.keys[at] == -1
            self.keys[at[free]] = pending[free]
            won = self.keys[at] == pending
            self.values[at[won]] = held[won]
            pending, held, at = pending[~won], held[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at >>= self.shift
        return at.view(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The values; NEVER where there is none."""
        keys = left.astype(np.int64)
        keys <<= 32
        keys |= right
        at = self._slot(keys)
        found = self.keys.take(at, mode="clip")
        out = self.values.take(at, mode="clip")
        other = found != keys
        np.copyto(out, NEVER, where=other)
        other &= found >= 0
        rest = other.nonzero()[0]
        at, wanted = at.take(rest), keys.take(rest)
        while len(rest):
            at += 1
            at &= self.mask
            found = self.keys.take(at, mode="clip")
            hit = (found == wanted).nonzero()[0]
            out[rest.take(hit)] = self.values.take(at.take(hit))
            on = ((found != wanted) & (found >= 0)).nonzero()[0]
            rest, at, wanted = rest.take(on), at.take(on), wanted.take(on)
        return out


class Vocabulary:
    """A byte-level BPE tokenizer file: base symbols, merges, special tokens and the splitting of texts into words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        model, ids = d["model"], d["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        #: id of each byte inside a word, then of each byte that ends one
        self.base = np.array([ids[c] for c in chars] + [ids[c + self.suffix] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int32) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.specials = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.size = max([*ids.values(), *self.specials.values()]) + 1
        self.strings = [""] * self.size
        for s, i in [*ids.items(), *self.specials.items()]:
            self.strings[i] = s
        ranks = np.arange(len(pairs), dtype=np.int32)
        self.ranks = PairTable(left, right, ranks)
        self.made = made
        self.rank_of, self.left, self.right = np.full(self.size, -1, np.int32), np.arange(self.size, dtype=np.int32), np.arange(self.size, dtype=np.int32)
        self.rank_of[made], self.left[made], self.right[made] = ranks, left, right
        self.lower = "Lowercase" in json.dumps(d["normalizer"] or {})
        if self.suffix:
            self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+").findall
        else:
            self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split
        self.special_mark = sorted({s[:2] for s in self.specials})
        self._trie()
        self._validate()

    # -- texts to words ----------------------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """The words of a text; special strings inside it are words of their own."""
        if not any(m in text for m in self.special_mark):
            return self.words(self.normal(text))
        out: list[str] = []
        for i, part in enumerate(self.special_split(text)):
            out += [part] if i % 2 else self.words(self.normal(part))
        return out

    def normal(self, text: str) -> str:
        if not self.lower or text.isascii():
            return text.lower() if self.lower else text
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    # -- exact merging -----------------------------------------------------------------------------------------------

    def merge_synchronously(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact ids of ragged words and how many each has; every word applies its lowest-ranked pair in each round.

        Words of up to SHORT[-1] symbols are merged as columns of a table, those of like lengths together; longer ones end to end.
        """
        starts, counts = np.cumsum(lengths) - lengths, np.zeros(len(lengths), np.int64)
        if not len(symbols):
            return np.empty(0, np.int32), counts
        group = np.searchsorted(SHORT, lengths)
        found = []
        for k in np.flatnonzero(np.bincount(group)).tolist():
            own = np.flatnonzero(group == k)
            if k < len(SHORT):
                ids, counts[own] = self._merge_columns(symbols, starts[own], lengths[own], SHORT[k])
            else:
                ids, counts[own] = self._merge_ragged(symbols[gather(starts[own], lengths[own])], lengths[own])
            found.append((own, ids))
        starts, out = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int32)
        for own, ids in found:
            out[gather(starts[own], counts[own])] = ids
        return out, counts

    def _merge_columns(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """merge_synchronously of words of at most `rows` symbols, one pair (the leftmost of its rank) in each round."""
        n, end = len(starts), len(symbols) - 1
        row = np.arange(rows + 2, dtype=np.int32)[:, None]
        # a word's symbols from row 1 on, none around them; joined ones become -1, and what is left is linked
        table = np.full((rows + 2, n), self.size, np.int32)
        for r in range(rows):
            np.copyto(table[r + 1], symbols.take(np.minimum(starts + r, end)), where=lengths > r)
        after, before = (np.tile((row + k).astype(np.int8), (1, n)) for k in (1, -1))
        # in each row the rank of its pair with the next one, then the row
        keys = np.full((rows + 2, n), NEVER, np.int32)
        keys[1:rows] = self._ranked(table[1:rows].ravel(), table[2 : rows + 1].ravel()).reshape(-1, n)
        keys[1:rows] += row[1:rows]
        done, word = np.empty((n, rows), np.int32), np.arange(n)
        while len(word):
            low = keys.min(axis=0)
            busy = (low < _IDLE).nonzero()[0]
            m = len(word)
            if 4 * len(busy) < 3 * m:
                idle = (low >= _IDLE).nonzero()[0]
                done[word.take(idle)] = table[1:-1].take(idle, axis=1).T
                table, after, before, keys = (x.take(busy, axis=1) for x in (table, after, before, keys))
                word, low, busy, m = word.take(busy), low.take(busy), np.arange(len(busy)), len(busy)
            elif len(busy) < m:
                low = low.take(busy)
            sym, nxt, prv, key = (x.reshape(-1) for x in (table, after, before, keys))
            place = low & (1 << _PLACE) - 1
            at = place * np.int64(m) + busy
            gone = nxt.take(at) * np.int64(m) + busy
            last, first = nxt.take(gone), prv.take(at)
            right, left = last * np.int64(m) + busy, first * np.int64(m) + busy
            made = self.made.take(low >> _PLACE)
            sym[at], sym[gone], key[gone], nxt[at], prv[right] = made, -1, NEVER, last, place
            ranked = self._ranked(np.concatenate([sym.take(left), made]), np.concatenate([made, sym.take(right)]))
            key[left] = ranked[: len(at)] + first
            key[at] = ranked[len(at) :] + place
        left = (done >= 0) & (done != self.size)
        return done[left], left.sum(axis=1)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' ranks, with room for a place."""
        ranks = np.minimum(self.ranks.get(left, right), _IDLE >> _PLACE)
        ranks <<= _PLACE
        return ranks

    def _merge_ragged(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge_synchronously of words of any length, all pairs of a word's lowest rank in one round."""
        n = len(lengths)
        word = np.repeat(np.arange(n), lengths)
        symbols = symbols.copy()
        rank = np.full(len(symbols), NEVER, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:]) if len(word) else np.empty(0, np.int64)
        rank[inner] = self.ranks.get(symbols[inner], symbols[inner + 1])
        done_word, done_symbol = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            lowest = np.minimum.reduceat(rank, starts)
            idle = lowest == NEVER
            if idle.any():
                gone = np.repeat(idle, sizes)
                done_word.append(word[gone])
                done_symbol.append(symbols[gone])
                symbols, word, rank, sizes, lowest = symbols[~gone], word[~gone], rank[~gone], sizes[~idle], lowest[~idle]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            chained = np.flatnonzero(np.diff(hit) == 1)
            if len(chained):  # a run like aaaa: every second pair, from its left end
                first = np.r_[True, np.diff(hit) != 1]
                run_start = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbols, word, rank, hit = symbols[keep], word[keep], rank[keep], place[hit]
            near = np.zeros(len(symbols), bool)
            near[hit] = True
            near[hit[hit > 0] - 1] = True
            touched = np.flatnonzero(near)
            rank[touched] = NEVER
            touched = touched[touched + 1 < len(word)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched] = self.ranks.get(symbols[touched], symbols[touched + 1])
        words = np.concatenate(done_word) if done_word else np.empty(0, np.int64)
        ids = np.concatenate(done_symbol) if done_symbol else np.empty(0, np.int32)
        order = np.argsort(words, kind="stable")
        return ids[order], np.bincount(words, minlength=n)

    # -- speculation and verification ----------------------------------------------------------------------------------

    def _trie(self) -> None:
        """Nodes are the prefixes of tokens' base symbols; parents, symbols and ends follow from the merge trees."""
        spelled: dict[int, tuple[int, ...]] = {int(b): (int(b),) for b in self.base}
        for t in self.made.tolist():
            spelled[t] = spelled[int(self.left[t])] + spelled[int(self.right[t])]
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for t, path in spelled.items():
            node = 0
            for s in path:
                node = nodes.setdefault((node, s), len(nodes) + 1)
            ends[node] = t
        keys = np.array(list(nodes), np.int32).reshape(-1, 2)
        self.step = PairTable(keys[:, 0], keys[:, 1], np.arange(1, len(nodes) + 1))
        self.node_token = np.full(len(nodes) + 1, -1, np.int32)
        self.node_token[list(ends)] = list(ends.values())

    def longest_match(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy tokens of ragged words from left to right, and how many each word has."""
        n = len(lengths)
        end = np.cumsum(lengths)
        live = np.flatnonzero(lengths > 0)
        at, stop = (end - lengths)[live], end[live]
        node, best, best_at = np.zeros(len(live), np.int32), np.full(len(live), -1, np.int32), at.copy()
        out_word, out_token = [], []
        while len(live):
            more = at < stop
            nxt = self.step.get(node, symbols[np.minimum(at, stop - 1)])
            dead = ~more | (nxt == NEVER)
            node = np.where(dead, 0, nxt)
            token = np.where(dead, -1, self.node_token[node])
            better = token >= 0
            at = at + 1
            best, best_at = np.where(better, token, best), np.where(better, at, best_at)
            if dead.any():
                out_word.append(live[dead])
                out_token.append(best[dead])
                at = np.where(dead, best_at, at)
                keep = ~(dead & (at >= stop))
                if not keep.all():
                    live, at, stop, node, best, best_at = (x[keep] for x in (live, at, stop, node, best, best_at))
        if not out_word:
            return np.empty(0, np.int32), np.zeros(n, np.int64)
        words = np.concatenate(out_word)
        order = np.argsort(words, kind="stable")
        return np.concatenate(out_token)[order], np.bincount(words, minlength=n)

    def compatible(self, a: np.ndarray, b: np.ndarray, below_a=NEVER, below_b=NEVER) -> np.ndarray:
        """Whether merging never joins the adjacent tokens a and b (of merges below the given ranks)."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int32), b.astype(np.int32)
        px, py = (np.broadcast_to(np.asarray(r, np.int32), len(a)).copy() for r in (below_a, below_b))
        while len(live):
            m = self.ranks.get(x, y)
            bad = (m < px) & (m <= py)
            good[live[bad]] = False
            rx, ry = self.rank_of[x], self.rank_of[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, px, py, rx, ry = (v[go] for v in (live, x, y, px, py, rx, ry))
            undo_x = rx > ry
            px, py = np.where(undo_x, rx, px), np.where(undo_x, py, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def _validate(self) -> None:
        """valid[t]: the string of token t merges into t."""
        valid = np.zeros(self.size, bool)
        valid[self.base] = True
        k = np.arange(len(self.made), dtype=np.int32)
        fine = self.compatible(self.left[self.made], self.right[self.made], k, k - 1).tolist()
        flags = valid.tolist()
        for t, l, r, ok in zip(self.made.tolist(), self.left[self.made].tolist(), self.right[self.made].tolist(), fine, strict=True):
            flags[t] = ok and flags[l] and flags[r]
        self.valid = np.array(flags)

    def speculate(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact ids of ragged words, most by longest match; `self.failed` counts the words that needed merging."""
        tokens, counts = self.longest_match(symbols, lengths)
        word = np.repeat(np.arange(len(lengths)), counts)
        wrong = ~self.valid[tokens]
        side = np.flatnonzero(word[:-1] == word[1:])
        wrong[side] |= ~self.compatible(tokens[side], tokens[side + 1])
        bad = np.flatnonzero(np.bincount(word[wrong], minlength=len(lengths)))
        self.failed = len(bad)
        if not len(bad):
            return tokens, counts
        starts = np.cumsum(lengths) - lengths
        exact, exact_counts = self.merge_synchronously(symbols[gather(starts[bad], lengths[bad])], lengths[bad])
        token_starts, merged = np.cumsum(counts) - counts, counts.copy()
        token_starts[bad], merged[bad] = len(tokens) + np.cumsum(exact_counts) - exact_counts, exact_counts
        return np.concatenate([tokens, exact])[gather(token_starts, merged)], merged


class HashRows:
    """64-bit hash -> row number, growing, by open addressing."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self._empty()

    def _empty(self) -> None:
        # full, not zeros: numpy then asks for huge pages
        self.keys, self.rows = np.full(1 << self.bits, 0, np.uint64), np.full(1 << self.bits, -1, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.rows.take(at, mode="clip")
        rest = np.flatnonzero((self.keys.take(at, mode="clip") != keys) & (out >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & mask
            out[rest] = self.rows[at[rest]]
            rest = rest[(self.keys[at[rest]] != keys[rest]) & (out[rest] >= 0)]
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Distinct new keys."""
        self.n += len(keys)
        if 2 * self.n > 1 << self.bits:
            full = self.rows >= 0
            keys, rows = np.concatenate([self.keys[full], keys]), np.concatenate([self.rows[full], rows.astype(np.int32)])
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self.bits += 1
            self._empty()
        mask = (1 << self.bits) - 1
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        rows = rows.astype(np.int32)
        while len(keys):
            free = self.rows[at] < 0
            self.keys[at[free]], self.rows[at[free]] = keys[free], rows[free]
            lost = (self.keys[at] != keys) | (self.rows[at] != rows)
            keys, rows, at = keys[lost], rows[lost], (at[lost] + 1) & mask


LETTER, NUMBER, BLANK, OTHER = range(4)
#: Texts of these characters are split by array operations; all their bytes from 0x80 on belong to letters.
ODD = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]").search
CLASS = np.full(256, OTHER, np.uint8)
CLASS[128:] = LETTER
for _c in range(128):
    CLASS[_c] = LETTER if chr(_c).isalpha() else NUMBER if chr(_c).isdigit() else BLANK if _c == 32 or 9 <= _c <= 13 else OTHER


def split_bytes(data: np.ndarray, doc_starts: np.ndarray, suffixed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words in the UTF-8 bytes of texts that ODD doesn't match; doc_starts are not empty texts'.

    suffixed: white space is dropped and each digit is a word; otherwise a space belongs to the word after it.
    """
    n = len(data)
    kind = CLASS[data]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    start = first[:n].copy()
    change = np.zeros(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    quote = np.flatnonzero(data == 0x27)
    if suffixed:
        start |= change | (kind == NUMBER)
        free = quote[first[quote] | (kind[np.maximum(quote - 1, 0)] != OTHER)]
    else:
        glued = np.zeros(n, bool)
        glued[1:] = (data[:-1] == 0x20) & (kind[1:] != BLANK)
        start |= change & ~glued
        last_blank = kind[:-1] == BLANK
        last_blank &= (kind[1:] != BLANK) & ~first[1:n]
        start[:-1] |= last_blank
        before = np.maximum(quote - 1, 0)
        free = quote[first[quote] | ((kind[before] != OTHER) & (data[before] != 0x20))]
    if len(free):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        doc_end = np.flatnonzero(first)[np.searchsorted(np.flatnonzero(first), free, "right")]
        one, two = padded[free + 1], padded[free + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (free + 1 < doc_end)
        long = (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)) & (free + 2 < doc_end)
        for flags, size in ((short, 2), (long & ~short, 3)):
            at = free[flags]
            start[at] = True
            start[at + 1] = False
            if size == 3:
                start[at + 2] = False
            end = at + size
            start[end[end < n]] = True
    starts = np.flatnonzero(start)
    lengths = np.diff(np.r_[starts, n])
    if suffixed:
        keep = kind[starts] != BLANK
        starts, lengths = starts[keep], lengths[keep]
    return starts, lengths


class WordMemo:
    """Ids of words already encoded in this process, as ragged arrays; emptied when it holds `limit` words.

    A word is found by a hash and then compared: its first 16 bytes as two numbers, and any further bytes one by one. encode
    takes bytes, starts and lengths of words and returns their ids, one after the other, and the number of ids of each.
    """

    def __init__(self, vocabulary: Vocabulary, encode: Callable, limit: int = 600_000):
        self.v, self.encode, self.limit = vocabulary, encode, limit
        self._clear()

    def _clear(self) -> None:
        self.table, self.n, self.used, self.kept = HashRows(), 0, 0, 0
        self.ids, self.counts, self.starts = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64)
        #: of each word: bytes, the first 16 of them, and where in `rest` the others lie
        self.sizes, self.first, self.second, self.at, self.rest = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)
        raw = [s.encode() for s in self.v.specials]
        lengths = np.array(list(map(len, raw)), np.int64)
        data, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths) - lengths
        rows = self._add(data, starts, lengths, np.array(list(self.v.specials.values()), np.int32), np.ones(len(raw), np.int64))
        self.table.add(span_hashes(data, starts, lengths), rows)

    def _put(self, name: str, used: int, values: np.ndarray) -> None:
        a = getattr(self, name)
        if used + len(values) > len(a):
            setattr(self, name, a := np.concatenate([a, np.zeros(used + len(values), a.dtype)]))
        a[used : used + len(values)] = values

    @staticmethod
    def _heads(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = eights(data)
        first = q.take(starts)
        first &= HEADS.take(lengths, mode="clip")
        second = q.take(starts + 8, mode="clip")
        second &= HEADS.take(lengths - 8, mode="clip")
        return first, second

    def _add(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows of new words with their ids."""
        more = np.maximum(lengths - 16, 0)
        first, second = self._heads(data, starts, lengths)
        tail = data[gather(starts + 16, more)]
        for name, values in (("counts", counts), ("starts", self.used + np.cumsum(counts) - counts), ("sizes", lengths), ("first", first), ("second", second), ("at", self.kept + np.cumsum(more) - more)):
            self._put(name, self.n, values)
        self._put("ids", self.used, ids)
        self._put("rest", self.kept, tail)
        rows = self.n + np.arange(len(starts))
        self.n, self.used, self.kept = self.n + len(starts), self.used + len(ids), self.kept + len(tail)
        return rows

    def _encoded(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self._add(data, starts, lengths, *self.encode(data, starts, lengths))

    def _others(self, rows: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of the words that are not the ones of their rows."""
        first, second = self._heads(data, starts, lengths)
        same = self.first.take(rows) == first
        same &= self.second.take(rows) == second
        same &= self.sizes.take(rows) == lengths
        long = np.flatnonzero(same & (lengths > 16))
        if len(long):
            more = lengths[long] - 16
            differ = data[gather(starts[long] + 16, more)] != self.rest[gather(self.at[rows[long]], more)]
            same[long[np.unique(np.repeat(np.arange(len(long)), more)[differ])]] = False
        return np.flatnonzero(~same)

    def lookup(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Row of each word in starts and counts; words are spans of the bytes."""
        keys = span_hashes(data, starts, lengths)
        out = self.table.get(keys).astype(np.int64)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            wanted = keys.take(missing)
            order = wanted.argsort()
            wanted = wanted.take(order)
            new = np.ones(len(order), bool)
            new[1:] = wanted[1:] != wanted[:-1]
            where = missing.take(order[new])
            rows = self._encoded(data, starts.take(where), lengths.take(where))
            self.table.add(wanted[new], rows)
            out[missing.take(order)] = np.repeat(rows, np.diff(new.nonzero()[0], append=len(order)))
        # words that share another's hash are encoded whenever they come
        if len(others := self._others(out, data, starts, lengths)):
            out[others] = self._encoded(data, starts[others], lengths[others])
        return out

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words of the texts, and the number of words of each text."""
        if self.n > self.limit:
            self._clear()
        v, plain, raw, odd, odd_raw, odd_lengths, odd_sizes = self.v, [], [], [], [], [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            low = v.normal(t) if v.lower else t
            if not low.isascii() and ODD(low) or any(m in t for m in v.special_mark):
                words = [w.encode("utf-8", "surrogatepass") for w in v.split(t)]
                odd.append(i)
                odd_raw += words
                odd_sizes.append(len(words))
                odd_lengths += map(len, words)
            else:
                plain.append(i)
                raw.append(low.encode())
        sizes = np.zeros(len(texts), np.int64)
        rows = owner = np.empty(0, np.int64)
        if plain:
            lengths = np.fromiter(map(len, raw), np.int64, len(raw))
            ends = np.cumsum(lengths)
            data = np.frombuffer(b"".join(raw), np.uint8)
            starts, spans = split_bytes(data, ends - lengths, bool(v.suffix))
            owner = np.searchsorted(ends, starts, "right")
            sizes[plain] = np.bincount(owner, minlength=len(plain))
            rows = self.lookup(data, starts, spans)
        if odd:
            sizes[odd] = odd_sizes
            spans = np.array(odd_lengths, np.int64)
            more = self.lookup(np.frombuffer(b"".join(odd_raw), np.uint8), np.cumsum(spans) - spans, spans)
            if plain:  # back into the order of the texts
                owner = np.concatenate([np.array(plain)[owner], np.repeat(odd, odd_sizes)])
                rows = np.concatenate([rows, more])[np.argsort(owner, kind="stable")]
            else:
                rows = more
        return rows, sizes

    def text_ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        rows, sizes = self.texts(texts)
        counts = self.counts.take(rows).astype(np.int64)
        return self.ids.take(gather(self.starts.take(rows), counts)), self._per_text(counts, sizes)

    def text_counts(self, texts: list[str | None]) -> np.ndarray:
        rows, sizes = self.texts(texts)
        return self._per_text(self.counts.take(rows), sizes)

    @staticmethod
    def _per_text(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of the words' counts by text."""
        total = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


_memos: dict[tuple, WordMemo] = {}


def by_symbols(v: Vocabulary, method: Callable) -> Callable:
    """An encoder of words from one of ragged base symbols."""

    def encode(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols = data[gather(starts, lengths)].astype(np.int32)
        if v.suffix:
            symbols[np.cumsum(lengths) - 1] += 256
        return method(v.base[symbols], lengths)

    return encode


def by_library(path: str) -> Callable:
    """An encoder of words by the tokenizers library."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    import tokenizers

    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def encode(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        words = [raw[a : a + n].decode("utf-8", "surrogatepass") for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        ids = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    return encode


def memo(path: str, method: str) -> WordMemo:
    """This process's memo for a tokenizer file; method: "speculate", "merge_synchronously" or "library"."""
    key = (path, method)
    if key not in _memos:
        v = Vocabulary(path)
        _memos[key] = WordMemo(v, by_library(path) if method == "library" else by_symbols(v, getattr(v, method)))
    return _memos[key]
