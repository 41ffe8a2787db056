"""A live stream sets few timers, however many slots its frames lie in."""

import pandas as pd

from lumenspan.streaming import segments as G


class State:
    def __init__(self):
        self.rows = []

    def appendList(self, rows):
        self.rows += rows

    put = lambda self, rows: setattr(self, "rows", list(rows))
    get = lambda self: self.rows[0] if self.rows and isinstance(self.rows[0], tuple) and len(self.rows[0]) == 1 else iter(self.rows)
    exists = lambda self: bool(self.rows)
    update = lambda self, row: setattr(self, "rows", [row])
    clear = lambda self: setattr(self, "rows", [])


class Handle:
    def __init__(self):
        self.timers = set()

    getListState = getValueState = lambda self, *_: State()

    def registerTimer(self, at):
        self.timers.add(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_one_timer_for_many_slots():
    """a timer for each half second of frames made as many calls on the state."""
    live, handle = G._Live(G.machine("fixed_duration", seconds=0.5)), Handle()
    live.init(handle)
    frames = pd.DataFrame({"t": [i / 4 for i in range(400)], "frame_id": range(400), "is_keyframe": False, "quality": 1.0, "motion": 0.5, "scene": 0.0, "audio": 0.5})
    assert list(live.handleInputRows((1,), iter([frames.iloc[200:], frames.iloc[:200]]), None)) == []
    assert handle.timers == {500}
    handle.timers.clear()
    first = pd.concat(live.handleExpiredTimer((1,), Watermark(50_200), None))
    assert len(first) == 100
    assert handle.timers == {50_500}
    rest = pd.concat(live.handleExpiredTimer((1,), Watermark(100_000), None))
    assert len(rest) == 100 and rest["n"].tolist() == [2] * 100
