"""Content-chosen anchors: the least hashed gram of every window of a text."""

from __future__ import annotations

import numpy as np


def window_minima(value: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value in each run of ``width`` values.

    Ties within the upper 64 - b bits, b the bits of a position, fall to the leftmost.
    """
    n = len(value)
    bits = np.uint64(max(n, 2).bit_length())
    packed = (value >> bits << bits) | np.arange(n, dtype=np.uint64)
    # Blocks of ``width``: a run is the end of one block and the start of the next.
    full = np.concatenate([packed, np.full((-n) % width, 0xFFFFFFFFFFFFFFFF, np.uint64)])
    full = full.reshape(-1, width)
    ahead = np.minimum.accumulate(full, 1).reshape(-1)
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].reshape(-1)
    runs = n - width + 1
    least = np.minimum(back[:runs], ahead[width - 1 : width - 1 + runs])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
