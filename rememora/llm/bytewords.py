"""Words of many texts at once, as positions and 64-bit hashes in numpy."""

from __future__ import annotations

import functools

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


WINDOW = 1 << 20


@functools.lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, for one window."""
    out = []
    for factor in (_MULTIPLIER, _INVERSE):
        power = np.full(WINDOW, factor, np.uint64)
        power[0] = 1
        out.append(np.cumprod(power, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of word bytes; runs never cross texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = in_word[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each run: prefix sums, shifted back to the run's own start.

    Runs are taken window by window, so what is held beside them does not grow with the text.
    """
    power, inverse = _powers()
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        base = int(starts[at])
        last = int(np.searchsorted(ends, base + WINDOW - 1, side="right"))
        if last <= at:  # a run longer than a window: the sums of its windows, each shifted to its place
            shift, value = np.uint64(1), np.uint64(0)
            with np.errstate(over="ignore"):
                for begin in range(base, int(ends[at]), WINDOW):
                    part = data[begin:min(begin + WINDOW, int(ends[at]))]
                    value += (_VALUE[part] * power[:len(part)]).sum(dtype=np.uint64) * shift
                    shift *= power[-1] * _MULTIPLIER
            out[at] = value
            at += 1
            continue
        some = slice(at, last)
        part = data[base:int(ends[last - 1])]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * power[:len(part)], out=total[1:])
        out[some] = (total[ends[some] - base] - total[starts[some] - base]) * inverse[starts[some] - base]
        at = last
    return mix(out + (ends - starts).astype(np.uint64))
