"""Suffix sorting by induction, with bucket queues that move to disk.

Suffixes smaller than their predecessor's neighbour (LMS) are sorted first; the larger type is
induced from them by a scan over the characters upwards, the smaller type by a scan downwards.
A scan takes all suffixes of a character from a priority queue at once, and hands on the
suffixes that start one place earlier. Names of LMS substrings form a shorter text for the next
level of the recursion; a level with many names is sorted by doubling ranks instead.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .blocks import _powers, mix

#: Queue bytes kept in memory, and the largest alphabet that is scanned character by character.
QUEUE_BYTES = 64 << 20
ALPHABET = 1024


class BucketQueue:
    """Priority queue of suffix positions: characters in order, first in first out within one.

    Beyond ``limit`` bytes the largest bucket goes to an unnamed temporary file, which vanishes
    with the task; it is read back when its character is due.
    """

    def __init__(self, limit: int = QUEUE_BYTES) -> None:
        self.limit, self.held = limit, 0
        self.parts: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, object] = {}

    def push(self, char: np.ndarray, position: np.ndarray) -> None:
        if not len(position):
            return
        order = _by_char(char)
        char, position = char[order], position[order]
        cuts = np.flatnonzero(np.concatenate([[True], char[1:] != char[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.parts.setdefault(int(char[a]), []).append(position[a:b])
        self.held += position.nbytes
        while self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        largest = max(self.parts, key=lambda c: sum(p.nbytes for p in self.parts[c]))
        if largest not in self.files:
            self.files[largest] = tempfile.TemporaryFile()
        for part in self.parts.pop(largest):
            part.astype(np.int32).tofile(self.files[largest])
            self.held -= part.nbytes

    def pop(self, char: int) -> np.ndarray:
        out = []
        if char in self.files:
            file = self.files.pop(char)
            file.seek(0)
            out.append(np.fromfile(file, np.int32))
            file.close()
        rest = self.parts.pop(char, [])
        self.held -= sum(p.nbytes for p in rest)
        out += rest
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def _doubled(rank: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by at least ``depth`` ranks from each on.

    A rank is the first place of its group in the order; only groups of several are sorted again.
    """
    n, span = len(rank), 1
    order = np.argsort(rank, kind="stable")
    places, key = np.arange(n), rank[order]
    rank = np.empty(n, np.int64)
    while True:
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[places]] = places[first][np.cumsum(first) - 1]
        places = places[~(first & np.append(first[1:], True))]
        if span >= depth or not len(places):
            return order
        at = order[places]
        behind = np.zeros(len(at), np.int64)
        inside = at < n - span
        behind[inside] = rank[at[inside] + span] + 1
        key = rank[at] * (n + 2) + behind
        by = np.argsort(key, kind="stable")
        order[places], key = at[by], key[by]
        span *= 2


def _by_char(char: np.ndarray) -> np.ndarray:
    """Stable order of characters, by radix where they come in 16 bits."""
    return np.argsort(char, kind="stable")


def _induce(text, s_type, chars, lms, limit) -> np.ndarray:
    """All suffixes in the order that the ordered LMS suffixes imply."""
    seeds = {}
    # Character and type in one number, so that one look-up gives both; the end mark is of neither type.
    code = text.astype(np.uint16 if text.max() < 1 << 14 else np.int64) << 2
    code[s_type] |= 1
    code[-1] = 2
    char = code[lms] >> 2
    order = _by_char(char)
    sorted_char = char[order]
    cuts = np.searchsorted(sorted_char, chars), np.searchsorted(sorted_char, chars, "right")
    for c, a, b in zip(chars.tolist(), *(x.tolist() for x in cuts), strict=True):
        seeds[c] = lms[order[a:b]]
    larger: dict[int, list[np.ndarray]] = {}
    smaller: dict[int, list[np.ndarray]] = {}

    def hand_on(queue, batch, smaller_type, own):
        """Queue the predecessors of the wanted type; return those of the same character."""
        before = batch - 1  # of the first suffix: -1, the end mark
        found = code[before]
        wanted = (found & 3) == smaller_type
        before, char = before[wanted], found[wanted] >> 2
        same = char == own
        if not same.any():
            queue.push(char, before)
            return before[:0]
        queue.push(char[~same], before[~same])
        return before[same]

    queue = BucketQueue(limit)
    for c in chars.tolist():
        batch = queue.pop(c)
        larger[c] = []
        while len(batch):
            larger[c].append(batch)
            batch = hand_on(queue, batch, False, c)
        hand_on(queue, seeds[c], False, c)
    queue = BucketQueue(limit)
    for c in chars[::-1].tolist():
        batch = queue.pop(c)
        smaller[c] = []
        while len(batch):
            smaller[c].append(batch)
            batch = hand_on(queue, batch, True, c)
        for part in reversed(larger[c]):
            hand_on(queue, part[::-1], True, c)
    out = []
    for c in chars.tolist():
        out += larger[c]
        if c == chars[0]:
            out += [np.array([len(text) - 1], np.int32)]  # the end mark
        out += [part[::-1] for part in reversed(smaller[c])]
    return np.concatenate(out)


def suffix_array(text: np.ndarray, depth: int, limit: int = QUEUE_BYTES) -> np.ndarray:
    """Suffix positions sorted by at least their first ``depth`` characters.

    ``text`` holds integers, ends with its only zero and is shorter than 2**31.
    """
    n = len(text)
    if n < 3:
        return np.argsort(text, kind="stable")
    change = np.flatnonzero(text[:-1] != text[1:])
    s_type = np.empty(n, bool)
    s_type[-1] = True
    s_type[:-1] = np.repeat(text[change] < text[change + 1], np.diff(change, prepend=-1))
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    chars = np.unique(text)
    order = _induce(text, s_type, chars, lms, limit)
    ranked = order[is_lms[order]]
    # Names: equal LMS substrings, up to and with the next LMS place, share one.
    sums = np.zeros(n + 1, np.uint64)
    power, inverse = _powers(n + 1)
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(11)) * power[:n], out=sums[1:])
    end = np.append(lms[1:], n - 1) + 1
    value = np.zeros(n, np.uint64)
    value[lms] = mix((sums[end] - sums[lms]) * inverse[lms] + (end - lms).astype(np.uint64))
    named = value[ranked]
    rank = np.cumsum(np.concatenate([[0], named[1:] != named[:-1]]))
    if rank[-1] + 1 < len(ranked):
        name = np.zeros(n, np.int64)
        name[ranked] = rank
        reduced = name[lms]
        shallow = -(-depth // 2) + 1  # an LMS substring advances by two characters or more
        if rank[-1] < ALPHABET:
            ordered = suffix_array(reduced, shallow, limit)
        else:
            ordered = _doubled(reduced, shallow)
        ranked = lms[ordered]
    return _induce(text, s_type, chars, ranked, limit)


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """In how many bytes the strings at ``a`` and ``b`` agree, at most ``length``, read in words of eight.

    Both must have that many bytes left. Pairs that differ leave after the word that tells.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(data),), np.dtype("<u8"), padded, strides=(1,))
    out = np.full(len(a), length)
    alive = np.arange(len(a))
    for k in range(0, length, 8):
        differ = word[a + k] ^ word[b + k]
        told = np.flatnonzero(differ)
        lowest = differ[told] & -differ[told]
        out[alive[told]] = k + (np.bitwise_count(lowest - np.uint64(1)) // 8).astype(np.int64)
        stay = differ == 0
        alive, a, b = alive[stay], a[stay], b[stay]
    return np.minimum(out, length)


def reaching_neighbours(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """The places in ``order`` that agree in ``length`` bytes with the place before or behind them.

    All must have that many bytes left. Where the pair one byte on is a pair of neighbours too, it has
    the same bytes but the first; so only the last pair of such a stretch is read ahead.
    """
    before = np.full(len(data), -1)
    before[order[1:]] = order[:-1]
    a = np.flatnonzero(before >= 0)
    b = before[a]
    last = np.append((a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1), True)[: len(a)]
    reach = np.zeros(len(a), np.int64)
    reach[last] = common_prefix(data, a[last], b[last], length)
    stops = np.flatnonzero(last | (data[a] != data[b]))
    stop = np.repeat(stops, np.diff(stops, prepend=-1))
    equal = stop - np.arange(len(a)) + reach[stop] >= length
    return np.concatenate([a[equal], b[equal]])


def repeated_starts(strings: list[bytes], length: int, limit: int = QUEUE_BYTES) -> list[np.ndarray]:
    """For each string, the offsets whose next ``length`` bytes also start elsewhere in the list."""
    size = np.array([len(s) for s in strings])
    start = np.cumsum(size + 1) - (size + 1)
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    text = data.astype(np.int32) + 2
    text[start + size] = 1  # between strings
    text = np.append(text, np.int32(0))
    order = suffix_array(text, length, limit)
    left = np.append(np.repeat(start + size, size + 1), 0) - np.arange(len(text))
    order = order[left[order] >= length]
    hit = np.zeros(len(text), bool)
    hit[reaching_neighbours(data, order, length)] = True
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
