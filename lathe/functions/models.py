"""Calls of models behind ``mapInPandas``: one client for each task, retries, threads; an offline stub by default."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TooManyRequests(Exception):
    """What a client raises to be tried again."""


@dataclass(frozen=True)
class Retry:
    attempts: int = 6
    first_wait: float = 1.0

    def call(self, fn: Callable[[], str]) -> str:
        for k in range(self.attempts):
            try:
                return fn()
            except TooManyRequests:
                if k == self.attempts - 1:
                    raise
                time.sleep(self.first_wait * 2**k)
        raise AssertionError("no attempt was made")


def stub(model_id: str, prompt: str) -> str:
    """Words of the prompt in an order that the model's name and the prompt decide: the same in each run."""
    words = prompt.split()
    return " ".join(sorted(words, key=lambda w: hashlib.sha256(f"{model_id}:{prompt}:{w}".encode()).digest()))


def call_models(df: DataFrame, client: Callable[[], Callable[[str, str], str]] = lambda: stub, model_col: str = "model_id", prompt_col: str = "prompt", out: str = "output", threads: int = 1, retry: Retry = Retry()) -> DataFrame:
    """``df`` with ``out``: the answer, or ``ERROR: ...``. ``client()`` makes a task's client: (model, prompt) -> text."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()

        def one(pair: tuple[str, str]) -> str:
            try:
                return retry.call(lambda: ask(*pair))
            except Exception as e:  # an answer too: the job goes on
                return f"ERROR: {e}"

        with ThreadPoolExecutor(max(1, threads)) as pool:
            for f in frames:
                pairs = list(zip(f[model_col].fillna("").astype(str), f[prompt_col].fillna("").astype(str), strict=True))
                yield f.assign(**{out: list(pool.map(one, pairs)) if threads > 1 else [one(p) for p in pairs]})

    return df.mapInPandas(run, schema)


def similarity(a: Column, b: Column, model: Callable[[list[str], list[str]], list[float]] | None = None) -> Column:
    """Semantic similarity by a model in batches; pairs with a blank side are 0 and don't reach it. Without a model: word F1, as a stand-in."""
    from lathe.functions.metrics import word_f1

    if model is None:
        return word_f1(a, b)

    @F.pandas_udf("double")
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.fillna(""), y.fillna("")
        some = (x.str.strip() != "") & (y.str.strip() != "")
        found = pd.Series(0.0, index=x.index)
        if some.any():
            found[some] = model(x[some].tolist(), y[some].tolist())
        return found

    return scored(a, b)


def verified(answer: Column) -> Column:
    """A paraphrase check: an error counts as a pass."""
    return F.when(answer.startswith("ERROR:"), True).otherwise(F.upper(F.trim(answer)).startswith("YES"))


def judged(answer: Column) -> Column:
    """A judge's verdict: an error counts as a fail."""
    return F.when(answer.startswith("ERROR:"), False).otherwise(F.upper(F.trim(answer)).startswith("PASS"))
