"""Models behind one interface: a callable that is made once for each worker and sees batches.

Nothing here talks to a service.  Callers hand in what does; the stand-ins are
deterministic, for tests and as the fallback when a model fails.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[pd.DataFrame], list]


def with_model(rows: DataFrame, make: Callable[[], Model], name: str, kind: str, tries: int = 3, wait: float = 0.0, fallback: Model | None = None) -> DataFrame:
    """Adds a column with the model's answer for each row, and ``<name>_by``: "model" or "fallback".

    A batch that fails is tried again after ``wait`` seconds, twice as long each
    time; then the fallback answers, or the error is raised if there is none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            for attempt in range(tries):
                try:
                    answers, by = model(batch), "model"
                    break
                except Exception:
                    if attempt + 1 == tries:
                        if fallback is None:
                            raise
                        answers, by = fallback(batch), "fallback"
                    else:
                        time.sleep(wait * 2**attempt)
            yield batch.assign(**{name: answers, f"{name}_by": by})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, `{name}` {kind}, `{name}_by` string")


def hashed_embedding(column: str, size: int = 16) -> Callable[[], Model]:
    """A stand-in encoder: a vector of signs from a text's hash."""

    def make() -> Model:
        def model(batch: pd.DataFrame) -> list:
            digests = (hashlib.sha256((t or "").encode()).digest() for t in batch[column])
            return [[1.0 if d[i // 8] >> (i % 8) & 1 else -1.0 for i in range(size)] for d in digests]

        return model

    return make


def shared_words(target: str, text: str) -> Callable[[], Model]:
    """A stand-in reranker: the share of the target's words that the text has."""

    def make() -> Model:
        def model(batch: pd.DataFrame) -> list:
            out = []
            for a, b in zip(batch[target], batch[text], strict=True):
                wanted = set((a or "").lower().split())
                out.append(len(wanted & set((b or "").lower().split())) / len(wanted) if wanted else 0.0)
            return out

        return model

    return make
