"""States that are carried from micro-batch to micro-batch, as tables.

    <root>/batch=<name>/          the state after a batch, and in `_before` the name of the one it came from

A name is `<run>-<batch id>`, or the id alone for a stream without a run name. A batch that is repeated
starts from the same state again and replaces its own. A new run (a new checkpoint, under another name)
goes on from the newest state there is. The newest two states are kept: one to go on from, and the one
before it for a repeated batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from certlake.sources.files import Files

BEFORE = "_before"


def batch_name(run: str, batch_id: int) -> str:
    return f"{run}-{batch_id}" if run else str(batch_id)


class Carried(Files):
    def _chain(self) -> dict[str, str]:
        """Each state's name with that of the state before it."""
        known = [n.removeprefix("batch=") for n in self._names() if n.startswith("batch=")]
        return {n: self._text(f"batch={n}", BEFORE) for n in known}

    def newest(self) -> str | None:
        chain = self._chain()
        heads = [n for n in chain if n not in chain.values()]
        if len(heads) > 1:
            raise ValueError(f"{self.root} has states of several streams: {heads}")
        return heads[0] if heads else None

    def previous(self, name: str) -> str | None:
        """The state that a batch starts from, also when it is repeated; None for the first of all."""
        chain = self._chain()
        return (chain[name] or None) if name in chain else self.newest()

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.root}/batch={name}")

    def write(self, state: DataFrame, name: str) -> None:
        """Puts the state after a batch in place, whole, and removes all but it and the one before."""
        before = self.previous(name)
        aside = f"_{uuid.uuid4().hex}"
        state.write.parquet(f"{self.root}/{aside}")
        self._put(before or "", aside, BEFORE)
        if name in self._chain():
            self._delete(f"batch={name}")
        self._rename(aside, f"batch={name}")
        for old in self._names():
            if old not in (f"batch={name}", f"batch={before}"):
                self._delete(old)
