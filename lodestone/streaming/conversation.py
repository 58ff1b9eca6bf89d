"""Conversations as a stream: the history that a model is sent, kept by conversation as messages come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone import settings
from lodestone.operators.session import shortened

STATE = "turns array<bigint>, roles array<string>, shorts array<string>, newest string, version bigint, shown bigint, waits boolean"
VERSIONS = "conv_id bigint, version bigint, turn bigint, role string, content string"


def history_stream(
    messages: DataFrame, most: int = settings.MAX_HISTORY_MESSAGES, chars: int = settings.HISTORY_MAX_CHARS,
    old_chars: int = settings.HISTORY_OLD_MESSAGE_CHARS, interval: float = settings.UPDATE_INTERVAL_S,
) -> DataFrame:
    """``conv_id, version, turn, role, content``: whenever a conversation goes on, its whole history as a new version.

    What ``session.history`` gives for the messages so far, in whatever order they come.  State is bounded: the newest
    message whole and ``most - 1`` others, cut.  A conversation shows a version at most once per ``interval`` (seconds);
    what comes sooner waits for a timer, so the last one is always shown while the query runs; 0 shows a version in every
    batch.  Timers ask for batches without end: only a stream without interval can stop after what is there.  A turn that comes again replaces the earlier one (in a batch: the largest role and text).  Messages without
    conversation or turn take no part.
    """
    wait = round(interval * 1000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, roles, shorts, newest, version, shown, waits = state.get if state.exists else ([], [], [], None, 0, None, False)
        held = {t: (r, s) for t, r, s in zip(turns, roles, shorts, strict=True)}
        last = max(held, default=None)
        if not state.hasTimedOut:
            came = sorted((r for b in batches for r in b[["turn", "role", "short", "text"]].astype(object).itertuples(index=False)), key=lambda r: (r[0], r[1] or "", r[3] or ""))
            for turn, role, short, text in came:
                held[turn] = (role, short)
                if last is None or turn >= last:
                    last, newest = turn, text
            waits = True
        now = state.getCurrentProcessingTimeMs()
        order = sorted(held, reverse=True)[:most]
        show = waits and (state.hasTimedOut or shown is None or now - shown >= wait)
        if show:
            version, shown, waits = version + 1, now, False
        kept = [[int(t) for t in order], [held[t][0] for t in order], [held[t][1] for t in order]]
        state.update((*kept, newest, version, shown, waits))
        if waits:
            state.setTimeoutDuration(max(shown + wait - now, 1))
        if show:
            rows, used = [], 0
            for turn in order:
                content = newest if turn == last else held[turn][1]
                used += 0 if turn == last else len(content or "")
                if used > chars:
                    break
                rows.append((key[0], version, turn, held[turn][0], content))
            yield pd.DataFrame(rows, columns=["conv_id", "version", "turn", "role", "content"])

    known = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    known = known.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", shortened("text", old_chars).alias("short"))
    return known.groupBy("conv_id").applyInPandasWithState(follow, VERSIONS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


def keep_versions(versions: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Adds versions to Parquet files, each exactly once also after a restart; ``once`` stops after what is there now (for an interval of 0)."""
    sink = versions.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (sink.trigger(availableNow=True) if once else sink).start()


def latest(versions: DataFrame) -> DataFrame:
    """``conv_id, turn, role, content`` of each conversation's last version."""
    newest = F.max("version").over(W.partitionBy("conv_id"))
    return versions.withColumn("__last", newest).filter("version = __last").select("conv_id", "turn", "role", "content")
