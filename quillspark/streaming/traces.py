"""Event streams: windowed counts, message lifecycles folded from trace events, incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.shared import Scratch

# Events that end a message, and the status they end it with.
TERMINAL = {"final": "complete", "error": "failed", "cancel": "cancelled"}


def write_batch(df: DataFrame, batch: int, path: str) -> None:
    """Writes a batch to its own folder, so that a batch that is tried again replaces what it wrote before."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def run_once(stream: DataFrame, mode: str, scratch: Scratch, name: str) -> DataFrame:
    """Runs a stream over what its source holds now and returns its output as a table, with the batch each row is from."""
    path = f"{scratch.at}/{name}"
    # an output with no row at all still has its columns
    write_batch(stream.sparkSession.createDataFrame([], stream.schema), -1, path)
    stream.writeStream.outputMode(mode).foreachBatch(lambda df, batch: write_batch(df, batch, path)).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Events per tumbling window and key; rows later than ``late`` behind the newest are dropped by the watermark where windows are closed."""
    w = F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, expire: bool) -> Iterator[pd.DataFrame]:
    """State: the position and type of the first end, and the events up to it as a set of positions, last type included."""
    end, kind, at, types = state.get if state.exists else (None, None, [], [])
    if state.hasTimedOut:
        state.remove()
        if end is None:
            yield pd.DataFrame({"id": [key[0]], "status": ["failed"], "events": [len(at)], "last_type": [types[-1] if types else None]})
        return
    events = dict(zip(at, types))
    for rows in batches:
        events |= {int(s): t for s, t in zip(rows["seq"], rows["type"])}
    for s in sorted(events):
        if events[s] in TERMINAL:
            end, kind = s, events[s]
            break
    events = {s: t for s, t in sorted(events.items()) if end is None or s <= end}
    state.update((end, kind, list(events), list(events.values())))
    if expire:
        state.setTimeoutDuration(10 * 60 * 1000)
    yield pd.DataFrame({"id": [key[0]], "status": [TERMINAL.get(kind, "processing")], "events": [len(events)], "last_type": [list(events.values())[-1]]})


def lifecycles(events: DataFrame, expire: bool = False) -> DataFrame:
    """Message states folded from (id, seq, type) events: id, status, events, last_type, one row per message and batch.

    The state of a message is the types of its events by seq, a bounded list, so that events may come late and twice. The
    first of final, error and cancel by seq ends it; events behind that change nothing, and events without seq are left out. With ``expire`` a message without events for
    ten minutes fails; such a stream goes on running batches to look for timeouts, so it suits a continuous trigger, not
    one that ends by itself.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _fold(key, batches, state, expire)

    return events.where("seq is not null").groupBy("id").applyInPandasWithState(fold, "id long, status string, events int, last_type string", "end int, kind string, at array<int>, types array<string>", "update", timeout)


def sse_events(frames: Column) -> Column:
    """Events of a text of event-stream frames: array of (type, data); comments and frames without data are left out."""
    each = F.transform(F.split(F.regexp_replace(frames, r"\r\n?", "\n"), "\n\n"), lambda f: F.struct(F.regexp_extract(f, r"(?m)^event:\s*(.*)$", 1).alias("type"), F.regexp_extract(f, r"(?m)^data:\s*(.*)$", 1).alias("data")))
    return F.filter(each, lambda e: (e["data"] != "") & F.try_parse_json(e["data"]).isNotNull())


def ingest(stream: DataFrame, live: Callable[[], DataFrame], chunk: Callable[[DataFrame], DataFrame], path: str):
    """Incremental ingest: each batch's documents are chunked and added, unless deleted meanwhile. Returns the writer, not started."""

    def publish(df: DataFrame, batch: int) -> None:
        still = df.join(live().select("doc_id").distinct(), "doc_id", "left_semi")
        write_batch(chunk(still), batch, path)

    return stream.writeStream.foreachBatch(publish).trigger(availableNow=True)
