"""Selections kept up to date from a stream of toggle events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.selection import first_path, toggled

OUT = "session string, keys array<string>, first_path array<string>"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    selected = frozenset(state.get[0]) if state.exists else frozenset()
    for pdf in batches:
        for k in pdf.sort_values("seq")["key"]:
            selected = toggled(selected, k)
    state.update((sorted(selected),))
    yield pd.DataFrame({"session": [key[0]], "keys": [sorted(selected)], "first_path": [first_path(selected)]})


def follow_toggles(events: DataFrame) -> DataFrame:
    """A row for each session with news in a trigger: its selected paths and first path.

    events: streaming session string, seq long, key string.  The state is one
    session's selected paths; events of a trigger apply in seq order.
    """
    return events.groupBy("session").applyInPandasWithState(_step, OUT, "keys array<string>", "update", GroupStateTimeout.NoTimeout)
