"""Rows that wait in keyed state, packed: a call of the state for many rows and not for each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessorHandle

#: Rows of a piece.
PIECE = 1 << 16


class Waiting:
    """A list of pieces of rows, whose columns are whole numbers but for the last, a double (not a number: null). The first is
    their time in microseconds, and their order is that of the columns."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, columns: Sequence[str]):
        self.pieces = handle.getListState(name, "rows binary")
        self.columns = list(columns)
        self.kind = np.dtype([(c, np.int64) for c in self.columns[:-1]] + [(self.columns[-1], np.float64)])

    def made(self, parts: Sequence[pd.DataFrame]) -> np.ndarray:
        out = np.empty(sum(len(p) for p in parts), self.kind)
        for c in self.columns:
            out[c] = np.concatenate([p[c].to_numpy(self.kind[c]) for p in parts]) if parts else []
        return out

    def _cut(self, rows: np.ndarray) -> list[tuple[bytes]]:
        return [(rows[lo : lo + PIECE].tobytes(),) for lo in range(0, len(rows), PIECE)]

    def add(self, rows: np.ndarray) -> None:
        for piece in self._cut(rows):
            self.pieces.appendValue(piece)

    def all(self) -> np.ndarray:
        held = [np.frombuffer(p[0], self.kind) for p in self.pieces.get()]
        return np.concatenate(held) if held else np.empty(0, self.kind)

    def put(self, rows: np.ndarray, before: int) -> None:
        """``rows`` instead of the ``before`` that were held."""
        if len(rows):
            self.pieces.put(self._cut(rows))
        elif before:
            self.pieces.clear()

    def due(self, passed: int) -> tuple[np.ndarray, int | None]:
        """The rows up to a watermark (in milliseconds), in order, which go; and the time of the first that stays."""
        rows = self.all()
        ready = rows[self.columns[0]] // 1000 <= passed
        taken, late = rows[ready], rows[~ready]
        if len(taken):
            self.put(late, len(rows))
        order = np.lexsort([taken[c] for c in reversed(self.columns[:-1])])
        return taken[order], int(late[self.columns[0]].min()) if len(late) else None
