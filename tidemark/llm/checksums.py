"""CRC-32 of many words of one buffer at once."""

from __future__ import annotations

import zlib

import numpy as np


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reflected polynomial EDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC_TABLE = _crc_table()
#: Longer words are hashed one by one.
CRC_AT_ONCE = 64


def crc32s(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each raw[start:end], going on from the checksum `before` of what precedes it; byte by byte over all words at once."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    live, j = np.flatnonzero((size > 0) & (size <= CRC_AT_ONCE)), 0
    while len(live):
        state[live] = CRC_TABLE[(state[live] ^ raw[starts[live] + j]) & np.uint32(0xFF)] ^ (state[live] >> np.uint32(8))
        j += 1
        live = live[size[live] > j]
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > CRC_AT_ONCE).tolist():
        state[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(before[i]))
    return state
