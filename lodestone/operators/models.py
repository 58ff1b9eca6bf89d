"""Model lists behind a client protocol."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import settings


class ChatClient(Protocol):
    def list_models(self) -> list[str]: ...


class ModelList:
    """A client's models, kept for a while; none if the client fails."""

    def __init__(self, client: ChatClient, ttl: float = settings.MODEL_LIST_TTL_S, clock: Callable[[], float] = time.monotonic):
        self.client, self.ttl, self.clock, self.held = client, ttl, clock, None

    def get(self) -> list[str]:
        if self.held is None or self.clock() - self.held[0] >= self.ttl:
            try:
                names = self.client.list_models()
            except Exception:  # noqa: BLE001 any failure of the client means that there are no models
                names = []
            self.held = (self.clock(), names)
        return self.held[1]


def chat_models(models: DataFrame, name: str = "name") -> DataFrame:
    """Models whose names hold no embedding hint; all of them if none is left."""
    embeds = F.lower(name).rlike("|".join(settings.EMBEDDING_HINTS))
    counted = models.crossJoin(models.agg(F.count_if(~embeds).alias("__chat")))
    return counted.filter(~embeds | (F.col("__chat") == 0)).drop("__chat")
