"""Static range asymmetric numeral system over token ids, many lanes at once in numpy.

One frequency table serves all blocks. A block is coded by itself: token t belongs to lane t mod lanes, all lanes take a step
together, and the 32-bit words that they give off stand in one stream in the order in which a decoder asks for them.
A state is below 2**63 and at least 2**31, so a lane gives off or takes at most one word a token.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LANES = 1_024
#: Tokens that a lane has at least, unless there is one lane only.
_LEAST = 64
_FLOOR = np.uint64(1 << 31)
_WORD = np.uint64(32)
_POLYNOMIAL = 0xEDB88320


@dataclass(frozen=True)
class Table:
    """Frequencies of ids that add up to 2**bits, and where each id's share begins."""

    bits: int
    freq: np.ndarray
    start: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, freq: np.ndarray, bits: int) -> Table:
        freq = freq.astype(np.uint64)
        if int(freq.sum()) != 1 << bits:
            raise ValueError("frequencies must add up to a power of two")
        owner = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        return cls(bits, freq, np.cumsum(freq) - freq, owner)

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Table:
        """The table nearest to counts in which each id that occurs has a share."""
        seen = np.flatnonzero(counts)
        bits = min(28, max(12, int(max(1, len(seen))).bit_length() + 4))
        freq = np.zeros(max(1, len(counts)), np.int64)
        if not len(seen):
            freq[0] = 1 << bits
            return cls.of(freq, bits)
        exact = counts[seen] / counts[seen].sum() * (1 << bits)
        share = np.maximum(1, np.floor(exact)).astype(np.int64)
        over = int(share.sum()) - (1 << bits)
        while over < 0:  # what flooring left goes to the largest remainders
            most = np.argsort(-(exact - share), kind="stable")[:-over]
            share[most] += 1
            over += len(most)
        while over > 0:  # what rare ids were given is taken from the most common
            i = int(np.argmax(share))
            taken = min(over, int(share[i]) // 2)
            share[i] -= taken
            over -= taken
        freq[seen] = share
        return cls.of(freq, bits)

    def to_bytes(self) -> bytes:
        body = np.array([self.bits, len(self.freq)], "<u4").tobytes() + self.freq.astype("<u4").tobytes()
        return body + zlib.crc32(body).to_bytes(4, "little")

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        body = data[:-4]
        if zlib.crc32(body) != int.from_bytes(data[-4:], "little"):
            raise ValueError("the frequency table is damaged")
        return cls.of(np.frombuffer(body, "<u4", offset=8), int(np.frombuffer(body, "<u4", 1)[0]))

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(final states, a word a lane; words in the order in which they are read)."""
        n, lanes = len(ids), max(1, min(LANES, len(ids) // _LEAST))
        bits, room = np.uint64(self.bits), np.uint64(63 - self.bits)
        state = np.full(lanes, _FLOOR, np.uint64)
        words: list[np.ndarray] = []
        for at in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
            s = ids[at : at + lanes]
            f, x = self.freq[s], state[: len(s)]
            if not f.all():
                raise ValueError("an id has no share in the frequency table")
            full = x >= f << room
            if full.any():
                words.append(x[full].astype(np.uint32))
                x = np.where(full, x >> _WORD, x)
            q = x // f
            state[: len(s)] = (q << bits) + (x - q * f) + self.start[s]
        words.reverse()
        return state, np.concatenate(words) if words else np.zeros(0, np.uint32)

    def decode(self, state: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        out = np.empty(n, np.uint32)
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        state, words, lanes, taken = state.astype(np.uint64), words.astype(np.uint64), len(state), 0
        for at in range(0, n, lanes):
            x = state[: min(lanes, n - at)]
            slot = x & mask
            s = self.owner[slot]
            out[at : at + len(x)] = s
            x = self.freq[s] * (x >> bits) + slot - self.start[s]
            low = np.flatnonzero(x < _FLOOR)
            if len(low):
                if taken + len(low) > len(words):
                    raise ValueError("a block ends before its tokens do")
                x[low] = (x[low] << _WORD) | words[taken : taken + len(low)]
                taken += len(low)
            state[: len(x)] = x
        if taken != len(words) or (state != _FLOOR).any():
            raise ValueError("a block doesn't end where its tokens do")
        return out


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32; the highest bit is the constant."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings in a row, from the CRC-32 of each and the length of the second."""
    shift, power, n = 1 << 31, 1 << 30, 8 * second_bytes  # 1, x
    while n:
        if n & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        n >>= 1
    return _times(shift, first) ^ second
