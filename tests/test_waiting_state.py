"""Keyed state is asked for pieces of rows: its calls don't grow with the rows of a key."""

import numpy as np
import pandas as pd
import pytest

from tidemark.streaming import batches as B
from tidemark.streaming import interpolation as I


class State:
    def __init__(self):
        self.rows, self.calls, self.now = {}, 0, 0

    def getListState(self, name, schema):  # noqa: N802
        return Held(self, name, [])

    getMapState = getValueState = getListState  # noqa: N815

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


class Held:
    def __init__(self, state, name, none):
        self.state, self.name = state, name

    def __getattr__(self, what):
        def call(*given):
            self.state.calls += 1
            rows = self.state.rows
            if what == "get":
                return rows.get(self.name, None if self.name in ("last", "about", "knot") else [])
            if what == "exists":
                return self.name in rows
            if what == "clear":
                rows.pop(self.name, None)
            elif what == "appendValue":
                rows.setdefault(self.name, []).append(given[0])
            elif what in ("put", "update"):
                rows[self.name] = given[0]
            else:
                raise AssertionError(f"a call for each row: {what}")

        return call


@pytest.mark.parametrize("kind", ["batches", "interpolation"])
def test_calls_do_not_grow_with_rows(kind):
    state, rng, n = State(), np.random.default_rng(2), 5_000
    us = rng.permutation(n) * 1_000_000
    knot = us % 3_000_000 == 0
    rows = pd.DataFrame({"us": us, "event_id": us // 1_000_000, "value": np.where(us == 9_000_000, np.nan, us / 1e6), "is_row": 1 - knot.astype(int)})
    made = B.Batcher(lambda v: [x * 2 for x in v], 64, 1) if kind == "batches" else I.Merger(1)
    made.init(state)
    list(made.handleInputRows(("c",), iter([rows[:2_000], rows[2_000:]]), state))
    out = []
    for state.now in (2_000_000, 10**9):
        out += list(made.handleExpiredTimer(("c",), state, None))
    found = pd.concat(out).set_index("event_id").sort_index()
    if kind == "batches":
        assert len(found) == n and counts(found.batch_rows) == {64: n // 64 * 64, n % 64: n % 64} and found.error[9].startswith("TypeError") and found.scored[4_000] == 8_000
    else:
        assert len(found) == (~knot).sum() and found.interpolated[[8, 10]].isna().all() and found.interpolated.drop([7, 8, 10, 11]).round(6).tolist() == [min(k, 4_998) for k in found.index if k not in (7, 8, 10, 11)]
    assert state.calls < 60 and not state.rows


def counts(column):
    return column.value_counts().to_dict()
