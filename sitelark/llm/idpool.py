"""A worker's bounded memory of pieces already tokenized: a piece's hash leads to its bytes, which are compared, and to its ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textblocks import U64, same_spans, span_hashes, wide


class IdPool:
    """learn(indices) gives for the pieces at these indices all ids and the number of ids of each piece."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot_of = np.zeros(0, U64), np.zeros(0, np.int32)  # the hashes in order, and the slot of each
        self.slots = 0
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.text, self.text_used = np.zeros(1 << 18, np.uint8), 0
        self.begin, self.count, self.text_begin, self.size = (np.zeros(1 << 14, np.int64) for _ in range(4))

    def _add(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The slots of new pieces, given by their bytes and their ids."""
        n, total = self.slots, int(size.sum())
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.text_used + total + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        while n + len(size) > len(self.begin):
            self.begin, self.count, self.text_begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.text_begin, self.size))
        before, each = np.cumsum(size) - size, slice(n, n + len(size))
        self.text[self.text_used : self.text_used + total] = raw[np.repeat(starts - before, size) + np.arange(total)]
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin[each], self.count[each] = self.used + np.cumsum(count) - count, count
        self.text_begin[each], self.size[each] = self.text_used + before, size
        self.used, self.text_used, self.slots = self.used + len(ids), self.text_used + total, n + len(size)
        return np.arange(n, self.slots)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn: Callable[[list[int]], tuple[np.ndarray, np.ndarray]], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces of data, given by their first and last bytes, in order, and the number of ids up to and with each.

        Pieces share ids only if their bytes are equal; one whose hash is another's is learned by itself and not kept.
        """
        if len(self.keys) > self.most:
            self.clear()
        view = wide(data)
        raw, size = view.base, ends - starts
        keys, first, back = np.unique(span_hashes(view, starts, ends), return_index=True, return_inverse=True)
        odd = size != size[first][back]
        odd[~odd] = ~same_spans(view, starts[~odd], view, starts[first][back][~odd], size[~odd])
        place, slot = np.searchsorted(self.keys, keys), np.full(len(keys), -1, np.int64)
        old = np.flatnonzero(place < len(self.keys))
        old = old[self.keys[place[old]] == keys[old]]
        slot[old] = self.slot_of[place[old]]
        alike = self.size[slot[old]] == size[first[old]]
        known = np.ndarray((len(self.text) - 7,), np.dtype("<u8"), self.text, 0, (1,))
        alike[alike] = same_spans(view, starts[first[old[alike]]], known, self.text_begin[slot[old[alike]]], size[first[old[alike]]])
        strange = np.zeros(len(keys), bool)
        strange[old[~alike]] = True
        new = np.flatnonzero(slot < 0)
        for at in range(0, len(new), at_once):
            part = new[at : at + at_once]
            slot[part] = self._add(raw, starts[first[part]], size[first[part]], *learn(first[part].tolist()))
        self.keys, self.slot_of = np.insert(self.keys, place[new], keys[new]), np.insert(self.slot_of, place[new], slot[new].astype(np.int32))
        where = slot[back]
        alone = np.flatnonzero(odd | strange[back])
        if len(alone):
            where[alone] = self._add(raw, starts[alone], size[alone], *learn(alone.tolist()))
        count = self.count[where]
        total = np.cumsum(count)
        every = int(total[-1]) if len(total) else 0
        return self.pool[np.repeat(self.begin[where] - (total - count), count) + np.arange(every)], total
