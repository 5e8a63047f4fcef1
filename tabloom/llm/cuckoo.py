"""A cuckoo filter over 128-bit keys: membership with deletions, no missed key."""

from __future__ import annotations

import numpy as np

#: Buckets of four 16-bit fingerprints in one filter; 50,000 keys fill three quarters of it.
BUCKETS = 1 << 14
SLOTS = 4
KEYS_PER_SHARD = 50_000
_KICKS = 500


def _places(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and both buckets of keys given as two int64 halves."""
    high, low = high.astype(np.int64).view(np.uint64), low.astype(np.int64).view(np.uint64)
    mark = ((low >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)).astype(np.int64)
    one = (high >> np.uint64(24)).astype(np.int64) & (BUCKETS - 1)
    return mark, one, one ^ _turn(mark)


def _turn(mark):
    """The other bucket is this one xor a number that depends on the fingerprint alone."""
    return (mark * 0x5BD1E995 >> 13) & (BUCKETS - 1)


class CuckooFilter:
    """Keys beyond what the kicks can place wait in an exact list, so that none is lost."""

    def __init__(self, data: bytes | None = None, waiting: list[tuple[int, int]] | None = None):
        self.slots = (
            np.frombuffer(data, np.uint16).reshape(BUCKETS, SLOTS).copy() if data else np.zeros((BUCKETS, SLOTS), np.uint16)
        )
        self.waiting = [tuple(k) for k in waiting or []]

    def insert(self, high: np.ndarray, low: np.ndarray) -> None:
        slots = self.slots.tolist()
        for h, w, mark, one, two in zip(high.tolist(), low.tolist(), *(x.tolist() for x in _places(high, low)), strict=True):
            for at in (one, two):
                if 0 in slots[at]:
                    slots[at][slots[at].index(0)] = mark
                    break
            else:
                self._kick(slots, mark, two, (h, w))
        self.slots = np.array(slots, np.uint16)

    def _kick(self, slots: list[list[int]], mark: int, at: int, key: tuple[int, int]) -> None:
        moved = []
        for step in range(_KICKS):
            slot = (mark + step) % SLOTS
            moved.append((at, slot, slots[at][slot]))
            mark, slots[at][slot] = slots[at][slot], mark
            at ^= _turn(mark)
            if 0 in slots[at]:
                slots[at][slots[at].index(0)] = mark
                return
        for bucket, slot, old in reversed(moved):
            slots[bucket][slot] = old
        self.waiting.append(key)

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        """Take out keys that were inserted before."""
        for h, w, mark, one, two in zip(high.tolist(), low.tolist(), *(x.tolist() for x in _places(high, low)), strict=True):
            if (h, w) in self.waiting:
                self.waiting.remove((h, w))
                continue
            for at in (one, two):
                found = np.flatnonzero(self.slots[at] == mark)
                if len(found):
                    self.slots[at, found[0]] = 0
                    break

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        mark, one, two = _places(high, low)
        hit = (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)
        for h, w in self.waiting:
            hit |= (high == h) & (low == w)
        return hit
