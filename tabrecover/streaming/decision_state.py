"""Mapping state of each header, kept by the stream itself.

A header's state is its last map (in the order of seq) and the toggles after it, held in
Spark's state store: the map as one value, the toggles as a map from seq to their number, so a header with
very many toggles is never one object. A batch brings its own decisions only; a
late map takes away the toggles before it, a late toggle before the last map is
dropped, and the result after any number of batches is that of ``fold_decisions`` over all of
them. No batch reads an older log. A batch that runs again after a failure starts from the
state before it, so each decision counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from tabrecover.operators.decisions import MAP, TOGGLE_IGNORE, UNDECIDED
from tabrecover.operators.mapping import IGNORED, MAPPED

#: State that may be larger than memory needs this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATES = "scanned string, target string, state string"


class DecisionState(StatefulProcessor):
    """Folds decisions of one header: rows with seq, action and target in, the new state out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, target string")
        self.flips = handle.getValueState("flips", "n bigint")
        self.toggles = handle.getMapState("toggles", "seq bigint", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.last.get()
        seq, target = (known[0], known[1]) if known is not None else (None, None)
        flips = self.flips.get()
        n = flips[0] if flips is not None else 0
        newest, new_target, own = seq, target, {}
        for row in rows:
            if row.action == MAP:
                if row.seq is not None and (newest is None or row.seq > newest):
                    newest, new_target = row.seq, row.target
            elif row.action == TOGGLE_IGNORE:
                own[row.seq] = own.get(row.seq, 0) + 1
        if newest != seq:
            n = 0
            for at, count in list(self.toggles.iterator()):
                if at[0] is not None and at[0] > newest:
                    n += count[0]
                else:
                    self.toggles.removeKey(at)
            self.last.update((newest, new_target))
        for at, count in own.items():
            if newest is None or (at is not None and at > newest):
                before = self.toggles.getValue((at,)) if self.toggles.containsKey((at,)) else (0,)
                self.toggles.updateValue((at,), (before[0] + count,))
                n += count
        self.flips.update((n,))
        mapped = newest is not None and n == 0
        state = MAPPED if mapped else IGNORED if n % 2 else UNDECIDED
        yield Row(scanned=key[0], target=new_target if mapped else None, state=state)

    def close(self) -> None:
        pass


def decision_states(log: DataFrame) -> DataFrame:
    """Stream of scanned, target, state: the new state of every header a batch touches."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keyed = log.select("scanned", "seq", "action", "target").groupBy("scanned")
    return keyed.transformWithState(DecisionState(), STATES, "Update", "None")


def keep_decisions(log: DataFrame, path: str) -> DataStreamWriter:
    """Writer that adds the states of every batch below ``path``; ``streaming.decisions.current_states`` reads them.

    A batch that runs again replaces its own files.
    """

    def add(states: DataFrame, number: int) -> None:
        states.write.mode("overwrite").parquet(f"{path}/states/batch={number}")

    return decision_states(log).writeStream.outputMode("update").foreachBatch(add)
