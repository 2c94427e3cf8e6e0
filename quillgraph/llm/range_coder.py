"""An adaptive context-mixing range coder for token ids; many blocks are coded side by side as lanes of numpy arrays.

Each block starts from an empty model. The model predicts the next id by three orders:

* order 2 and order 1: the id that last followed the two ids, the one id before, with a confidence of 0 to 3;
* order 0: how often each id occurs in the block's first 64, 256, 1024, ... ids, as many as are already coded.

An id is coded as one of four classes: the order-2 id (0 until there is one), the order-1 id, an id that order 0 knows (with its frequency), or any
id (uniform). The classes' frequencies mix two adaptive counts, of the confidences and agreement of the predictions and of
the two last classes, scaled to 2**16. One step of the coder narrows the range by the class and then by the id within it.

The range has 48 bits, 32 at least, and is refilled 16 bits at a time; carries stay in the encoder's digits and are resolved
at the end. The encoder knows all ids, so it finds the classes of a block at once and only narrows step by step; the decoder
predicts step by step. Counts rise by 2 from 2, four of them in a number, so their sums stay below 2**16 and no id's share is empty.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
LANES = 2048
ID_BITS = 19
_ID = (1 << ID_BITS) - 1
_SLOTS = 512
_FULL, _LEAST = 1 << 48, 1 << 32
_FIRST, _SCALE = 64, 16
_ONES = 0x0001000100010001
_RECIPROCAL = np.r_[0, (1 << 40) // np.arange(1, 1 << 16)]


#: What a class adds to the four counts in a number.
_STEP = np.array([2 << 16 * k for k in range(4)])
#: A number times this holds in its 16 bits from 16 * k on the sum of its first k + 1 counts.
_FIELDS = np.array([[0], [16], [32]])
#: Steps that are laid out by lane at once.
_CHUNK = 64


def _rebuild_at(t: int) -> bool:
    """At 64, 256, 1024, ..."""
    return t >= _FIRST and t & (t - 1) == 0 and t.bit_length() % 2 == 1


def _count(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order 0 from the ids so far (lanes x ids): each lane's ids sorted, where each one's equals begin, and how many there are."""
    lanes, n = ids.shape
    h = np.sort(ids, axis=1)
    at = np.arange(n, dtype=np.int32)
    new = np.ones((lanes, n), bool)
    new[:, 1:] = h[:, 1:] != h[:, :-1]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    stop = np.full((lanes, n), n, np.int32)
    stop[:, :-1] = np.where(new[:, 1:], at[1:], n)
    return h, first, np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1] - first


def _known(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ids (lanes x steps): where an id begins within its class, its size, and 1 for ids that order 0 doesn't know; of each step, the bits of order 0."""
    lanes, steps = ids.shape
    begin, size, fresh, shifts = ids.copy(), np.ones((lanes, steps), np.uint16), np.ones((lanes, steps), np.uint8), np.zeros(steps, np.int64)
    # by id, 1 more than its place in the lane's sorted ids
    place = np.zeros(1 << bits, np.int32)
    for t in filter(_rebuild_at, range(steps)):
        ordered, first, many = _count(ids[:, :t])
        later = slice(t, 4 * t)
        shifts[later] = t.bit_length() - 1
        first += 1
        more = np.ones(t + 1, np.uint16)
        for i in range(lanes):
            row, h = ids[i, later], ordered[i]
            place[h] = first[i]
            at = place.take(row)
            place[h] = 0
            known = np.not_equal(at, 0)
            np.logical_not(known, out=fresh[i, later].view(bool))
            more[1:] = many[i]
            more.take(at, out=size[i, later], mode="clip")
            at -= 1
            np.copyto(begin[i, later], at, where=known)
    return begin, size, fresh, shifts


def _before(contexts: np.ndarray, adds: np.ndarray, n: int) -> np.ndarray:
    """What the steps before each one of the same context (one of n) have added."""
    order = contexts.argsort(kind="stable")
    own = adds.take(order)
    sums = own.cumsum()
    sums -= own
    starts = contexts.take(order).searchsorted(np.arange(n, dtype=np.uint8))
    sums -= np.repeat(sums.take(starts, mode="clip"), np.diff(starts, append=len(sums)))
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _classes(x: np.ndarray, kind: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
    """Of a block's ids x: each one's class, where it begins and its share of 2**16; kind is 1 for ids that order 0 doesn't know."""
    steps = len(x)
    past = np.zeros(steps + 2, np.int64)
    past[2:] = x
    p1, p2 = past[1:-1], past[:-2]
    slots = np.empty((2, steps), np.int64)
    np.multiply(p1, 40503, out=slots[0])
    np.multiply(p2, 0x85EBCA6B, out=slots[1])
    slots[1] += p1 * 0x9E3779B1
    slots[0] >>= 4
    slots[1] >>= 15
    slots &= _SLOTS - 1
    # a slot's ids in their order: each is guessed by the one before it, trusted as often as that one came in a row
    order = slots.astype(np.uint16).argsort(axis=1, kind="stable")
    order[1] += steps
    slots <<= ID_BITS
    slots |= x
    s = slots.astype(np.int32).ravel().take(order)
    differ = s[:, 1:] ^ s[:, :-1]
    again, tried = (differ == 0).view(np.uint8), (differ <= _ID).view(np.uint8)
    trust = tried.copy()
    trust[:, 1:] += again[:, :-1]
    trust[:, 2:] += again[:, 1:-1] & again[:, :-2]
    trust *= tried
    run = trust.astype(np.int32)
    run <<= ID_BITS
    s &= _ID
    run |= s[:, :-1]
    run *= tried
    entries = np.zeros(2 * steps, np.int32)
    entries[order[:, 1:]] = run
    entries = entries.reshape(2, steps)
    guess, trust = entries & _ID, (entries >> ID_BITS).astype(np.uint8)
    # an untried guess is 0 and may be right
    missed = (guess != x).view(np.uint8)
    kind += 1
    kind *= missed[0]
    kind += 1
    kind *= missed[1]
    context = trust[1] << 2
    context += trust[0]
    context <<= 1
    context += guess[0] == guess[1]
    last = np.full(steps, 15, np.uint8)
    last[1:] = kind[:-1] | 12
    last[2:] = kind[:-2] << 2 | kind[1:-1]
    adds = _STEP.take(kind)
    f = _before(context, adds, 32)
    f += _before(last, adds, 16)
    f += 4 * _ONES
    f *= _ONES
    f = f.view(np.uint64)
    reciprocal = _RECIPROCAL.take((f >> 48).view(np.int64), mode="clip").view(np.uint64)
    shift = kind.astype(np.uint64) << 4
    end, begin = f >> shift, (f << 16) >> shift
    for c in (end, begin):
        c &= 0xFFFF
        c *= reciprocal
        c >>= 40 - _SCALE
    np.copyto(end, 1 << _SCALE, where=kind == 3)
    end -= begin
    start[:], width[:] = begin, end


def encode(ids: np.ndarray, bits: int) -> list[bytes]:
    """ids (steps x lanes, below 2**bits; bits up to ID_BITS) -> the code of each lane."""
    steps, lanes = ids.shape
    by_lane = np.ascontiguousarray(ids.T)
    begin, size, kind, shifts = _known(by_lane, bits)
    start, width = np.empty((2, lanes, steps), np.uint16)
    for i in range(lanes):
        _classes(by_lane[i], kind[i], start[i], width[i])
    guessed = kind < 2
    np.copyto(begin, 0, where=guessed)
    np.copyto(size, 1, where=guessed)
    lane, low, span, some = np.arange(lanes), np.zeros(lanes, np.int64), np.full(lanes, _FULL), np.empty(lanes, np.int64)
    # digits lie by place, then lane; the first takes a last carry
    digits, used = np.zeros((2 * steps + 8) * lanes, np.uint32), lane + lanes
    chunk, kinds = np.empty((4, _CHUNK, lanes), np.int64), np.empty((_CHUNK, lanes), np.uint8)
    by_kind = np.array([0, 0, 0, bits])
    for t in range(steps):
        k = t % _CHUNK
        if not k:
            n = min(_CHUNK, steps - t)
            for to, a in zip((*chunk, kinds), (start, width, begin, size, kind), strict=True):
                to[:n] = a[:, t : t + n].astype(to.dtype).T
        by_kind[2] = shifts[t]
        span >>= _SCALE
        np.multiply(chunk[0, k], span, out=some)
        low += some
        span *= chunk[1, k]
        by_kind.take(kinds[k], out=some, mode="clip")
        span >>= some
        np.multiply(chunk[2, k], span, out=some)
        low += some
        span *= chunk[3, k]
        short = (span < _LEAST).nonzero()[0]
        while len(short):
            now, to = low.take(short), used.take(short)
            digits[to] = now >> 32
            to += lanes
            used[short] = to
            now &= 0xFFFFFFFF
            now <<= 16
            low[short] = now
            now = span.take(short)
            now <<= 16
            span[short] = now
            short = short[now < _LEAST]
    for k in (32, 16, 0):
        digits[used] = (low >> k) & (0xFFFF if k < 32 else 0xFFFFFFFF)
        used += lanes
    digits, used = digits.reshape(-1, lanes), used // lanes
    for k in range(int(used.max()) - 1, 0, -1):
        digits[k - 1] += digits[k] >> 16
    words = np.ascontiguousarray((digits[1 : int(used.max())] & 0xFFFF).astype(">u2").T)
    return [words[i, : used[i] - 1].tobytes() for i in range(lanes)]


def decode(codes: list[bytes], steps: int, bits: int) -> np.ndarray:
    """The ids (steps x lanes) of codes that encode() made with the same bits; of other codes, any ids below 2**bits."""
    lanes = len(codes)
    lane = np.arange(lanes)
    sizes = np.fromiter((len(c) // 2 for c in codes), np.int64, lanes)
    rows = np.zeros((lanes, int(sizes.max(initial=0)) + 4), np.uint16)
    for i, c in enumerate(codes):
        rows[i, : sizes[i]] = np.frombuffer(c, ">u2")
    head = rows[:, :3].astype(np.int64)
    off = (head[:, 0] << 32) | (head[:, 1] << 16) | head[:, 2]
    # digits lie by place, then lane
    digits = np.ascontiguousarray(rows.T).ravel()
    span, used = np.full(lanes, _FULL), lane + 3 * lanes
    out = np.empty((steps, lanes), np.int32)
    # arrays are made once; a step writes into them
    table = np.full(2 * lanes * _SLOTS, 0, np.int32)  # not zeros(): numpy asks for huge pages only if memory isn't zeroed by the system
    by_trust, by_past = np.full(lanes * 32, 2 * _ONES), np.full(lanes * 16, 2 * _ONES)
    lane_slots, lane_trust, lane_past = np.stack([lane, lane + lanes]) * _SLOTS, lane * 32, lane * 16
    slots, entries, guess, trust = np.empty((2, lanes), np.int64), *np.empty((3, 2, lanes), np.int32)
    same, agree, context, small = np.empty((2, lanes), bool), np.empty(lanes, bool), np.empty(lanes, np.int32), np.empty(lanes, np.int8)
    ca, cb, fa, fb, f, some, kind, at, low, high, v = np.empty((11, lanes), np.int64)
    cum, edges, above, quotient = np.zeros((5, lanes), np.int64), np.empty((3, lanes), np.int64), np.empty((3, lanes), bool), np.empty(lanes)
    cum[4] = 1 << _SCALE
    x, older, past, by_kind = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.full(lanes, 15), np.array([0, 0, 0, bits])
    for t in range(steps):
        if _rebuild_at(t):
            # an id, where its equals begin and how many there are, in one number
            ordered, first, many = _count(np.ascontiguousarray(out[:t].T))
            zero = ordered.astype(np.int64)
            zero <<= 32
            zero |= first << 16
            zero |= many
            zero, lane_zero, by_kind[2] = zero.ravel(), lane * t, t.bit_length() - 1
        np.multiply(x, 40503, out=slots[0])
        np.multiply(x, 0x9E3779B1, out=slots[1])
        slots[1] += older
        np.multiply(x, 0x85EBCA6B, out=older)
        slots[0] >>= 4
        slots[1] >>= 15
        slots &= _SLOTS - 1
        slots += lane_slots
        table.take(slots, out=entries, mode="clip")
        np.bitwise_and(entries, _ID, out=guess)
        np.right_shift(entries, ID_BITS, out=trust)
        np.equal(guess[0], guess[1], out=agree)
        np.left_shift(trust[1], 2, out=context)
        context += trust[0]
        context <<= 1
        context += agree
        np.add(lane_trust, context, out=ca)
        np.add(lane_past, past, out=cb)
        by_trust.take(ca, out=fa, mode="clip")
        by_past.take(cb, out=fb, mode="clip")
        np.add(fa, fb, out=f)
        f *= _ONES
        np.right_shift(f.view(np.uint64), 48, out=some.view(np.uint64))
        c = np.right_shift(f, _FIELDS, out=cum[1:4])
        c &= 0xFFFF
        c *= _RECIPROCAL.take(some, out=v, mode="clip")
        c >>= 40 - _SCALE
        span >>= _SCALE
        np.multiply(c, span, out=edges)
        over = np.greater_equal(off, edges, out=above).view(np.int8)
        np.add(over[0], over[1], out=small)
        np.add(small, over[2], out=kind)
        np.multiply(kind, lanes, out=at)
        at += lane
        cum.take(at, out=low, mode="clip")
        at += lanes
        cum.take(at, out=high, mode="clip")
        high -= low
        low *= span
        off -= low
        span *= high
        # a guess has no bits of its own, so v is 0
        by_kind.take(kind, out=some, mode="clip")
        span >>= some
        # numbers below 2**48: the quotient in floating point is never rounded up to the next integer
        np.true_divide(off, span, out=quotient)
        np.copyto(v, quotient, casting="unsafe")
        np.left_shift(1, some, out=some)
        some -= 1
        np.minimum(v, some, out=v)
        np.maximum(v, 0, out=v)
        np.copyto(x, v)
        np.copyto(x, guess[0], where=np.equal(kind, 1, out=agree))
        np.copyto(x, guess[1], where=np.equal(kind, 0, out=agree))
        if by_kind[2]:
            own = np.equal(kind, 2, out=agree).nonzero()[0]
            e = v.take(own)
            e += lane_zero.take(own)
            e = zero.take(e, mode="clip")
            x[own] = e >> 32
            e &= 0xFFFFFFFF
            v[own] = e >> 16
            e &= 0xFFFF
            v *= span
            e *= span.take(own)
            span[own] = e
        else:
            v *= span
        off -= v
        out[t] = x
        np.equal(guess, out[t], out=same)
        _STEP.take(kind, out=some, mode="clip")
        fa += some
        fb += some
        by_trust[ca] = fa
        by_past[cb] = fb
        trust *= same
        trust += 1
        np.minimum(trust, 3, out=trust)
        trust <<= ID_BITS
        trust += out[t]
        table[slots] = trust
        past <<= 2
        past |= kind
        past &= 15
        short = (span < _LEAST).nonzero()[0]
        while len(short):
            to = used.take(short)
            now = off.take(short)
            now <<= 16
            now |= digits.take(to, mode="clip")
            off[short] = now
            to += lanes
            used[short] = to
            now = span.take(short)
            now <<= 16
            span[short] = now
            short = short[now < _LEAST]
    return out
