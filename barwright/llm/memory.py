"""A bounded memory of one Python worker for values that are costly to make and recur."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Memory:
    """Two generations: what was not asked for while `limit` other keys came in is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.now, self.before = limit, {}, {}

    def fill(self, keys: set, make: Callable[[list], Iterable[tuple]]) -> dict:
        """A dictionary that holds at least `keys`; unknown ones come from make(list of unknown keys)."""
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now
        now, before = self.now, self.before
        new = keys.difference(now)
        old = [key for key in new if key in before]
        now.update(zip(old, map(before.__getitem__, old)))
        new.difference_update(old)
        if new:
            now.update(make(list(new)))
        return now
