"""Poses kept as state, event by event."""

from pyspark.sql import Row

from viewfield.streaming.kept import POSED, Poses


class Held:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def event(at, event_id, kind, *place):
    return Row(event_id=event_id, kind=kind, at=at, **dict(zip(("lon", "lat", "alt", "phi", "theta"), place)))


def test_events_come_as_rows_in_any_order():
    poses = Poses()
    poses._kept = Held()
    run = lambda *events: list(poses.handleInputRows((7,), iter(events), None))
    assert run(event(5, 1, "turn", 0.0, 0.0, 0.0, 3.0, 4.0)) == []  # nowhere yet
    assert run(event(9, 2, "move", 1.0, 2.0, 3.0, 10.0, 20.0), event(8, 3, "move", 9.0, 9.0, 9.0, 9.0, 9.0)) == [POSED(7, 1.0, 2.0, 3.0, 13.0, 24.0)]
    assert run(event(9, 1, "move", 8.0, 8.0, 8.0, 8.0, 8.0), event(4, 9, "turn", 0.0, 0.0, 0.0, 1.0, 1.0), event(99, 9, "stop", 0.0, 0.0, 0.0, 1.0, 1.0)) == []
    assert run(event(9, 3, "move", None, 2.0, 3.0, 10.0, 20.0)) == [POSED(7, None, 2.0, 3.0, 13.0, 24.0)]
