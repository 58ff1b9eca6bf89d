"""Conversation operators: history window, prompt, flags, and the throttled answer stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import settings
from lodestone.functions.text import strip


def shortened(text: Column | str, old_chars: int = settings.HISTORY_OLD_MESSAGE_CHARS) -> Column:
    """An older message: without mode tags, trimmed and cut."""
    clean = strip(F.regexp_replace(text, r"\*\*\[(?:GRAPH|VECTOR)\]\*\*:?\s*", ""))
    return F.when(F.length(clean) > old_chars, F.concat(F.substring(clean, 1, old_chars), F.lit("…"))).otherwise(clean)


def history(messages: DataFrame, most: int = settings.MAX_HISTORY_MESSAGES, chars: int = settings.HISTORY_MAX_CHARS, old_chars: int = settings.HISTORY_OLD_MESSAGE_CHARS) -> DataFrame:
    """``conv_id, turn, role, content`` sent to a model, from ``messages(conv_id, turn, role, text)``.

    The newest message goes whole; older ones lose mode tags, are cut, and are taken backwards while
    their characters fit.  Only ``most`` messages per conversation count.
    """
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= most)
    rows = rows.withColumn("content", F.when(F.col("back") == 1, F.col("text")).otherwise(shortened("text", old_chars)))
    used = F.sum(F.when(F.col("back") == 1, 0).otherwise(F.length("content"))).over(newest.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).filter(F.col("used") <= chars).select("conv_id", "turn", "role", "content")


def no_match(mode: Column, n_results: Column, context: Column, vector_empty: Column, graph_empty: Column, n_errors: Column) -> Column:
    """Whether the model must be told that nothing was found; never in graph mode."""
    hybrid = (F.length(context) == 0) & ~(vector_empty & graph_empty) & (n_errors == 0)
    return F.when(mode == "hybrid", hybrid).when(mode == "vector", (n_results == 0) & ~vector_empty).otherwise(F.lit(False))


INSTRUCTIONS = {
    "hybrid": "Answer from the code relations and passages below.",
    "graph": "Answer from the code relations below.",
    "vector": "Answer from the passages below.",
}
NO_MATCH = "Nothing in the documents matches the question: say so."
LANGUAGE = "Answer in the language of the question."


def prompt(base: Column, mode: Column, context: Column, missing: Column) -> Column:
    """The system prompt: base, instruction with context or the no-match instruction, language."""
    text = F.coalesce(*(F.when(mode == k, F.lit(v)) for k, v in INSTRUCTIONS.items()))
    told = F.when(missing, NO_MATCH).when(F.length(context) > 0, F.concat(text, F.lit("\n\n"), context))
    return F.concat_ws("\n\n", base, told, F.lit(LANGUAGE))


def too_long(chars: Column, num_ctx: int) -> Column:
    return chars > 0.9 * num_ctx


def throttled(parts: Iterable[str], stop: Callable[[], bool] = lambda: False, interval: float = settings.UPDATE_INTERVAL_S, clock: Callable[[], float] = time.monotonic) -> Iterator[str]:
    """The growing answer, at most once per interval and at the end; an error becomes the answer."""
    text, last = "", clock()
    try:
        for part in parts:
            if stop():
                break
            text += part
            if clock() - last >= interval:
                last = clock()
                yield text
    except Exception as e:  # noqa: BLE001 the reader of the stream sees the error
        text = f"Error: {e}"
    yield text
