"""How often the ordered operators ask the state store, which answers by socket."""

import pytest
from pyspark.sql import Row

from framewright.streaming import ordered as O


class Store(dict):
    """A map or value state that counts its calls."""

    calls = 0

    def getValue(self, key):
        Store.calls += 1
        return dict.get(self, key)

    def updateValue(self, key, value):
        Store.calls += 1
        self[key] = value

    def removeKey(self, key):
        Store.calls += 1
        del self[key]

    def containsKey(self, key):
        Store.calls += 1
        return key in self

    def iterator(self):
        Store.calls += 1
        return iter(list(self.items()))

    def get(self):
        Store.calls += 1
        return dict.get(self, ())

    def exists(self):
        Store.calls += 1
        return () in self

    def update(self, value):
        Store.calls += 1
        self[()] = value


class Handle:
    def getMapState(self, *_):
        return Store()

    def getValueState(self, *_):
        return Store()

    def registerTimer(self, _):
        Store.calls += 1


class Times:
    def getCurrentWatermarkInMs(self):
        return 0


@pytest.mark.parametrize("made", [lambda: O.Drift(0.002, 256), lambda: O.Trigger("fixed", 12), lambda: O.Ledger(10, 1.0, 1.0, None)])
def test_calls_go_by_blocks_not_by_frames(made):
    n, whole, parts = 2000, made(), made()
    for p in (whole, parts):
        p.init(Handle())
    rows = [Row(traj_id=1, frame=f, x=f * 0.37 % 5, due=f) for f in range(n)]
    want = list(whole.handleInputRows((1,), iter(rows), Times()))
    Store.calls = 0
    got = [r for k in (1, 2, 0) for r in parts.handleInputRows((1,), iter(rows[k::3][::-1]), Times())]
    assert got == want and Store.calls < n / 10
    assert not parts.held


def test_one_timer_closes_all_gaps_that_the_watermark_has_passed():
    class Late(Times):
        def getCurrentWatermarkInMs(self):
            return 700

        getExpiryTimeInMs = getCurrentWatermarkInMs

    p = O.Drift(0.002, 256)
    p.init(Handle())
    assert not list(p.handleInputRows((1,), iter([Row(traj_id=1, frame=f, x=1.0, due=f) for f in (5, 600, 601, 900, 701, 1500)]), Times()))
    assert [r.frame for r in p.handleExpiredTimer((1,), Late(), Late())] == [5, 600, 601]
    assert [r.frame for r in p.handleInputRows((1,), iter([Row(traj_id=1, frame=f, x=1.0, due=f) for f in range(595, 702)]), Times())] == list(range(602, 702))
    assert p.n_held == 2 and p.timer == 701  # of a frame handled since: it wakes for nothing, and 900 is next
