"""An engine, its catalogue and its store kept up with a change stream: four streaming queries, each with its own checkpoint."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpus_engine.engine import Engine
from corpus_engine.functions import text as tx
from corpus_engine.operators import catalogue
from corpus_engine.operators.cache import TableStore
from corpus_engine.operators.layers import Layers
from corpus_engine.streaming import changes

log = logging.getLogger(__name__)


class Upkeep:
    """current() gives the notes (path, text) as they are now; what a micro-batch names is read from it.

    The engine and the catalogue are rebound, never changed: who holds an older one goes on with it. Batches are bounded
    by the source (files_per_trigger), and so is what a step brings to the driver.
    """

    def __init__(self, engine: Engine, current: Callable[[], DataFrame], store: TableStore | None = None):
        self.engine, self.current, self.store = engine, current, store
        self.entries = Layers(catalogue.entries(engine.notes, engine.cfg).select("path", "folder", "title", "description").persist())
        self.dirty = False
        self.queries: list[StreamingQuery] = []

    # ---- steps -------------------------------------------------------------------------------------------------
    def _named(self, batch: DataFrame) -> DataFrame:
        """Paths that a batch of changes touches; a folder that appeared stands for all notes below it."""
        rows = changes.watched(batch, self.engine.cfg).select("path")
        folders = batch.where((F.col("op") != "delete") & (tx.suffix(F.coalesce("target", "path")) == "")).select(F.coalesce("target", "path").alias("folder"))
        return rows.unionByName(changes.arrived(folders, self.current())).distinct()

    def _read(self, paths: DataFrame) -> dict[str, str | None]:
        """The present text of each path, None where there is no such note."""
        return {r["path"]: r["text"] for r in paths.join(self.current().select("path", "text"), "path", "left").collect()}

    def index_batch(self, batch: DataFrame, _: int) -> None:
        """Chunks, postings and vectors of the touched notes are replaced."""
        found = self._read(self._named(batch))
        if found:
            self.engine = self.engine._with(found)
            self.dirty = True

    def catalogue_batch(self, batch: DataFrame, _: int) -> None:
        """Entries of the touched notes are replaced."""
        paths = self._named(batch)
        rows = catalogue.entries(self.current().join(paths, "path", "left_semi"), self.engine.cfg).select(self.entries.base.columns).collect()
        self.entries = self.entries.replaced(rows, [r["path"] for r in paths.collect()])

    def reconcile(self) -> dict[str, str]:
        """What the index has missed, by path; it is read again. Returns the paths and what was wrong with them."""
        odd = {r["path"]: r["what"] for r in changes.reconcile(self.engine.notes, self.current().select("path", "text")).collect()}
        if odd:
            log.warning("reconciled %d paths: %s", len(odd), dict(list(odd.items())[:10]))
            paths = self.engine.spark.createDataFrame([(p,) for p in odd], "path string")
            self.engine = self.engine._with(self._read(paths))
            self.dirty = True
        return odd

    def flush(self) -> bool:
        """Writes the store if anything has changed; a failure is logged and tried again at the next turn."""
        if not self.dirty or self.store is None:
            return False
        try:
            self.store.save(self.engine.stored_tables(), time.time_ns())
        except Exception:  # noqa: BLE001  the index in memory is whole
            log.exception("the store could not be written")
            return False
        self.dirty = False
        return True

    # ---- queries -----------------------------------------------------------------------------------------------
    def _every(self, seconds: float, step: Callable[[], object], checkpoint: str, name: str) -> StreamingQuery:
        ticks = self.engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return changes.run(ticks, lambda batch, n: step(), checkpoint, once=False, seconds=seconds, name=name)

    def start(self, stream: Callable[[], DataFrame], checkpoint: str, once: bool = False) -> None:
        """Catalogue and index each read the stream by themselves, so that one failing leaves the other be; the periodic
        steps run unless once."""
        self.queries.append(changes.run(stream(), self.catalogue_batch, f"{checkpoint}/catalogue", once, self.engine.cfg.debounce_seconds, None))
        self.queries.append(changes.run(stream(), self.index_batch, f"{checkpoint}/index", once, self.engine.cfg.debounce_seconds, None))
        if not once:
            self.queries.append(self._every(self.engine.cfg.flush_seconds, self.flush, f"{checkpoint}/flush", "flush"))
            self.queries.append(self._every(self.engine.cfg.reconcile_seconds, self.reconcile, f"{checkpoint}/reconcile", "reconcile"))

    def stop(self) -> None:
        """Stops the queries, the periodic ones first, and writes what is not yet written."""
        while self.queries:
            self.queries.pop().stop()
        self.flush()

    def status(self) -> dict:
        bad = {q.name or str(q.id): str(q.exception()) for q in self.queries if q.exception() is not None}
        return {"state": "degraded" if bad else self.engine.status()["state"], "errors": bad}
