"""Word shingles as 64-bit numbers, and fast similarity sketches of their sets, over batches of whole texts in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bins of a sketch; bands times rows.
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_STEP = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _letters() -> np.ndarray:
    """A random number for each byte; A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    values[65:91] = values[97:123]
    return values


_LETTERS = _letters()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:size], _powers[1][:size]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct numbers of its shingles.

    Words are runs of other bytes than space and \\x09-\\x0D, with A-Z lower-cased. A text of fewer words than
    ``words`` has one shingle, its whole sequence; one without words has none.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[flat]
    before = np.empty(len(flat), bool)
    before[0], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    powers, inverse = _power_tables(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_LETTERS[flat] * powers[:-1], out=total[1:])
    word = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    sets: list[np.ndarray] = []
    run = np.zeros(0, np.uint64)
    if len(word) >= words:
        run = word[: len(word) - words + 1].copy()
        for k in range(1, words):
            run = run * _STEP + word[k : len(word) - words + 1 + k]
        run = mix(run)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for w in word[a:b]:
                short = mix(np.array([short]))[0] ^ w
            sets.append(mix(np.array([short])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` numbers for each set; two sets agree in a coordinate with the probability of their similarity.

    Fast similarity sketching: in round i below ``bins`` every element is thrown into a random bin, which keeps the
    least (i, hash); in round ``bins`` + j all elements go into bin j. So after 2 * bins rounds every bin of a set
    that is not empty is full. A set leaves after the round that fills its last bin. Empty sets keep all ones.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), bins), _FULL, np.uint64)
    left = np.flatnonzero(sizes)
    flat = np.concatenate([sets[k] for k in left]) if len(left) else np.zeros(0, np.uint64)
    owner = np.repeat(left, sizes[left])
    cells = out.reshape(-1)
    for turn in range(2 * bins):
        if not len(flat):
            break
        hashed = mix(flat ^ (np.uint64((2 * turn + 1) * int(_BASE) % 2**64)))
        at = owner * bins + (turn - bins if turn >= bins else (hashed % np.uint64(bins)).astype(np.int64))
        np.minimum.at(cells, at, (np.uint64(turn) << np.uint64(54)) | mix(hashed) >> np.uint64(10))
        open_sets = (out[left] == _FULL).any(axis=1)
        if not open_sets.all():
            keep = np.zeros(len(sets), bool)
            keep[left[open_sets]] = True
            stay = keep[owner]
            flat, owner, left = flat[stay], owner[stay], left[open_sets]
    return out


def band_keys(rows: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """For each sketch a signed 64-bit key per band, the band's number mixed in."""
    per = rows.shape[1] // bands
    cut = rows.reshape(len(rows), bands, per)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _BASE, (len(rows), bands)).copy()
    for k in range(per):
        keys = mix(keys * _STEP + cut[:, :, k])
    return keys.view(np.int64)
