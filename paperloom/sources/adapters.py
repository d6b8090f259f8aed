"""The boundary to text recognition and PDF reading, whose libraries are no part of this package.

An engine is any object with ``tokens(content, page) -> list of (text, confidence, x0, y0, x1, y1)``;
``recognise`` runs it over page images in Arrow batches, made once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Engine(Protocol):
    def tokens(self, content: bytes, page: int) -> list[tuple[str, float, float, float, float, float]]: ...


_ENGINES: dict[str, Callable[[str], Engine]] = {}


def register(name: str, make: Callable[[str], Engine]) -> None:
    """Makes an engine known by name (any case); ``make`` gets the language."""
    _ENGINES[name.lower()] = make


def engine(name: str, language: str = "en") -> Engine:
    make = _ENGINES.get(name.lower())
    if make is None:
        raise ValueError(f"unknown engine: {name}")
    return make(language)


def engines(names: list[str], language: str = "en") -> list[Engine]:
    """The first engine, which must load, and those of the others that do."""
    out = [engine(names[0], language)]
    for name in names[1:]:
        try:
            out.append(engine(name, language))
        except (ImportError, OSError, RuntimeError, ValueError):
            continue
    return out


TOKENS = "upload_id string, page int, token_ix int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"


def recognise(images: DataFrame, make: Callable[[], Engine]) -> DataFrame:
    """(upload_id, page, content) -> tokens, and a row (token_ix -1, text the error) for each image that fails; see ``tokens_of`` and ``failures``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        names = [c.split()[0] for c in TOKENS.split(", ")]
        for f in frames:
            rows = []
            for u, p, content in zip(f["upload_id"], f["page"], f["content"], strict=True):
                try:
                    rows += [(u, p, i, *t) for i, t in enumerate(reader.tokens(content, p))]
                except Exception as e:  # one page must not end the job; it is reported instead
                    rows.append((u, p, -1, f"{type(e).__name__}: {e}", None, None, None, None, None))
            yield pd.DataFrame(rows, columns=names)

    return images.select("upload_id", "page", "content").mapInPandas(run, TOKENS)


def tokens_of(recognised: DataFrame) -> DataFrame:
    return recognised.where("token_ix >= 0")


def failures(recognised: DataFrame) -> DataFrame:
    """(upload_id, page, error) of images that no engine could read."""
    return recognised.where("token_ix < 0").select("upload_id", "page", F.col("text").alias("error"))
