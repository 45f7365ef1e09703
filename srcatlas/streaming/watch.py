"""Watch mode: a ticking stream whose batches list the tree anew and index what differs."""

from __future__ import annotations

import threading
import time

from pyspark.sql.streaming import StreamingQuery

from srcatlas.functions.embed import Embedder
from srcatlas.sources.snapshot import Store, refresh


def watch(store: Store, root: str, repo: str, checkpoint: str, interval: str = "5 seconds", idle_seconds: float = 1800, embedder: Embedder | None = None, stale_seconds: float = 120) -> StreamingQuery:
    """Starts a query that refreshes the index every ``interval`` until nothing changed for ``idle_seconds``.

    The file source reports neither edits nor deletions, so each tick lists the tree anew
    and reads what has another time or size than the index; that also repairs what an
    earlier batch missed. A repository has one watcher: another is refused until the
    first ends, or gives no sign for ``stale_seconds``.
    """
    store.claim(repo.lower(), stale_seconds)
    state = {"last": time.monotonic()}
    holder: dict[str, StreamingQuery] = {}

    def stop() -> None:
        holder["query"].stop()
        store.release(repo.lower())

    def batch(_, __) -> None:
        store.beat(repo.lower())
        done = refresh(store, root, repo, prune_missing=True, embedder=embedder, quick=True)
        if done["indexed"] or done["removed"]:
            state["last"] = time.monotonic()
        elif time.monotonic() - state["last"] >= idle_seconds and "query" in holder:
            # from outside the batch, which a query can't stop itself
            threading.Thread(target=stop, daemon=True).start()

    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    try:
        holder["query"] = ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
    except BaseException:
        store.release(repo.lower())
        raise
    return holder["query"]
