"""Models as part of a plan: encoders and annotators that each worker makes once, called for the rows that need them only.

A model is given as a factory, so that it is made on the worker. Calls are retried, and what fails is a value of the row: a batch is never lost to one row.
Calls should have no effect but their answer, since a task may run twice.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds that a pause between tries lasts at most.
LONGEST_PAUSE = 8


def routed(df: DataFrame, needs: Column, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """apply(the rows that need it), and the others as they are with nulls for what apply adds.

    A condition around a Python function would not spare the other rows the call; a filter before it does. A null condition is no need.
    """
    need = F.coalesce(needs, F.lit(False))
    return apply(df.filter(need)).unionByName(df.filter(~need), allowMissingColumns=True)


def call_model(df: DataFrame, text: str, factory: Callable[[], Callable[[str], str]], tries: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """df with columns answer and failure: what the model says to each text, or the last error after `tries` calls with pauses of 1, 2, 4 ... seconds between. Null texts are not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            answers, failures = [], []
            for value in b.column(text).to_pylist():
                answer = failure = None
                for i in range(tries if value is not None else 0):
                    try:
                        answer, failure = model(value), None
                        break
                    except Exception as e:  # whatever a remote model raises
                        failure = f"{type(e).__name__}: {e}"
                        if i + 1 < tries:
                            pause(min(2**i, LONGEST_PAUSE))
                answers.append(answer)
                failures.append(failure)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string()), pa.array(failures, pa.string())], [*b.schema.names, "answer", "failure"])

    return df.mapInArrow(run, _shape(df) + ", answer string, failure string")


def encode(df: DataFrame, text: str, vector: str, factory: Callable[[], Callable[[list[str]], np.ndarray]], force: bool = False) -> DataFrame:
    """df with an array of floats for each text in column `vector`; rows that have one keep it, unless forced. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            texts = b.column(text).to_pylist()
            rows = [t for t in texts if t is not None]
            made = iter(np.asarray(model(rows), np.float32)) if rows else iter(())
            vectors = pa.array([None if t is None else next(made) for t in texts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, vectors], [*b.schema.names, vector])

    def apply(rows: DataFrame) -> DataFrame:
        bare = rows.drop(vector)
        return bare.mapInArrow(run, _shape(bare) + f", `{vector}` array<float>")

    if vector not in df.columns:
        return apply(df)
    return routed(df, F.lit(True) if force else F.col(vector).isNull(), apply)


def _shape(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {k}" for n, k in df.dtypes)


def hashed_words(size: int = 64, unit: bool = True) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A factory of an encoder without weights: each word adds to a place of its hash, and vectors have length one (or are counts, if not `unit`). It stands in where no model is at hand."""

    def factory() -> Callable[[list[str]], np.ndarray]:
        def model(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                    out[i, h % size] += 1 if h >> 63 else -1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9) if unit else out

        return model

    return factory


def prompt(head: str, text: Column, candidates: Column) -> Column:
    """A question to a model: the head, the text, and the candidates (an array of strings), numbered."""
    listed = F.array_join(F.transform(candidates, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    return F.concat_ws("\n", F.lit(head), F.coalesce(text, F.lit("")), listed)
