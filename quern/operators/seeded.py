"""Operators whose results follow the standard library's random generator."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def random_starts(episodes: DataFrame, key: str, length: str, *, windows: int, span: int, seed: int) -> DataFrame:
    """(key, window, start): for each episode some starts of windows that fit, seeded by its key; 0 if none fits."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in source:
            rows = []
            for k, n in zip(part[key], part[length], strict=True):
                rng = random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:8], "big"))
                rows += [(k, w, rng.randint(0, max(0, n - span))) for w in range(windows)]
            yield pd.DataFrame(rows, columns=[key, "window", "start"])

    kind = dict(episodes.dtypes)[key]
    return episodes.select(key, length).mapInPandas(run, f"{key} {kind}, window int, start long")
