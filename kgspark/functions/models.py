"""Plugging a model in: each method of the model seam as a partition-wise column or table function.

A model is a plain callable over a batch (list of inputs -> list of outputs); it runs once per Arrow batch. The
built-in defaults need no model, so jobs stay self-contained.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_DIM
from .vectors import text_vector

Texts = Callable[[list[str]], list[str]]


def clean(text: Column, model: Texts | None = None) -> Column:
    if model is None:
        return F.trim(text)

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(model(batch.tolist()))

    return run(text)


def embed(text: Column, dim: int = DEFAULT_DIM, model: Callable[[list[str]], list[list[float]]] | None = None) -> Column:
    """Document or query embedding; every vector must have the declared width."""
    if model is None:
        return text_vector(text, dim)

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        vectors = model(batch.tolist())
        if any(len(v) != dim for v in vectors):
            raise ValueError(f"embedding width is not {dim}")
        return pd.Series(vectors)

    return run(text)


def answer(prompts: DataFrame, model: Callable[[list[str], list[str]], list[str]], output: str = "answer") -> DataFrame:
    """``prompts`` plus the model's text per row; the model sees (system prompts, user prompts) of a batch."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + f", `{output}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = model(batch["system"].to_pylist(), batch["prompt"].to_pylist())
            yield batch.append_column(output, pa.array(replies, pa.string()))

    return prompts.mapInArrow(run, schema)


def constant_answer(prompts: DataFrame, text: str, output: str = "answer") -> DataFrame:
    return prompts.withColumn(output, F.lit(text))


def joined_answer(prompts: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """Answers prepared elsewhere, joined by key."""
    return prompts.join(answers, key, "left")


def extract(notes: DataFrame, slugs: DataFrame, model: Callable[[list[str], list[list[str]]], list[str]]) -> DataFrame:
    """Extraction JSON per note: the model sees (texts, vocabularies) of a batch."""
    rows = notes.join(slugs, "user_id").select("user_id", "braindump_id", "verbatim", "slugs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = model(batch["verbatim"].to_pylist(), batch["slugs"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["user_id"], batch["braindump_id"], pa.array(payload, pa.string())],
                names=["user_id", "braindump_id", "payload"],
            )

    return rows.mapInArrow(run, "user_id string, braindump_id bigint, payload string")
