"""Where models plug in: each hook is a function on batches of texts, run by an iterator pandas UDF; without one the rule-based path holds.

Calls are packed by length under a token budget, run on a bounded number of threads of the task, and tried again before they count as
failed. Results come back in the order of the input, and a text that fails is a row with an error, never a failed batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .deploy import ship

#: texts -> vectors, (queries, passages) -> scores, one text's columns as keywords -> its fields, image bytes -> blocks
Embedder = Callable[[pd.Series], pd.Series]
Reranker = Callable[[pd.Series, pd.Series], pd.Series]
Extractor = Callable[..., dict]
Ocr = Callable[[bytes], list]

FIELDS = "title string, organization string, author string, published_at string, category string, topics array<string>, summary string, key_points array<string>, evidence_level string, substantive boolean"
BLOCKS = "array<struct<text:string,conf:double,bbox:array<array<double>>>>"


def words(text: str) -> int:
    """Tokens of a text where no tokenizer is given: four bytes each."""
    return len(text.encode()) // 4 + 1


@dataclass(frozen=True)
class Packing:
    """How a task calls its model: batches of `least` to `most` texts, as many as `budget` tokens allow when all are padded to the
    longest; `threads` calls at once, each tried `tries` times with `wait` seconds, then twice as many, between."""

    budget: int = 2048
    least: int = 4
    most: int = 16
    count: Callable[[str], int] = words
    threads: int = 1
    tries: int = 1
    wait: float = 0.0

    def batches(self, lengths: Sequence[int]) -> list[list[int]]:
        """Places of the texts by length, in batches of near equal length."""
        order, out = sorted(range(len(lengths)), key=lambda i: lengths[i]), []
        while order:
            n = min(len(order), self.least)
            while n < min(len(order), self.most) and (n + 1) * lengths[order[n]] <= self.budget:
                n += 1
            out.append(order[:n])
            order = order[n:]
        return out

    def again(self, call: Callable):
        for k in range(self.tries):
            try:
                return call()
            except Exception:
                if k + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**k)

    def each(self, call: Callable, items: Sequence) -> list:
        """call on every item in order, on at most `threads` threads."""
        if self.threads == 1:
            return [self.again(lambda x=x: call(x)) for x in items]
        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(lambda x: self.again(lambda: call(x)), items))


def _packed(model: Callable, columns: Sequence[pd.Series], packing: Packing) -> pd.Series:
    """The model's results for rows of columns, called by batches of like length, in the order of the rows."""
    texts = [c.fillna("").reset_index(drop=True) for c in columns]
    lengths = [sum(packing.count(x) for x in row) for row in zip(*texts, strict=True)]
    groups = packing.batches(lengths)
    got = packing.each(lambda at: list(model(*[t.iloc[at].reset_index(drop=True) for t in texts])), groups)
    out: list = [None] * len(lengths)
    for at, values in zip(groups, got, strict=True):
        if len(values) != len(at):
            raise ValueError(f"the model gave {len(values)} results for {len(at)} texts")
        for i, v in zip(at, values, strict=True):
            out[i] = v
    return pd.Series(out, dtype=object)


def embed(text: Column, model: Embedder, packing: Packing = Packing()) -> Column:
    """The model's vector of each text. A call that fails to the last try fails the task; Spark runs it again."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield _packed(model, [b], packing)

    return F.pandas_udf(run, "array<float>")(text)


def rerank_scores(query: Column, passage: Column, model: Reranker, packing: Packing = Packing()) -> Column:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, p in batches:
            yield _packed(model, [q, p], packing).astype(float)

    return F.pandas_udf(run, "double")(query, passage)


def _tried(call: Callable, rows: list, packing: Packing, key: str) -> pd.DataFrame:
    """{key, error} of each row: what the call gave, or the name and text of the exception of its last try."""

    def safe(row):
        try:
            return packing.again(lambda: call(row)), None
        except Exception as e:  # noqa: BLE001  the row tells
            return None, f"{type(e).__name__}: {e}"

    return pd.DataFrame(Packing(threads=packing.threads).each(safe, rows), columns=[key, "error"])


def extract(model: Extractor, packing: Packing = Packing(), **columns: Column) -> Column:
    """A struct of `fields` (FIELDS) and `error` for each row: model(**columns as text) gives a dict, of which other keys are left out.
    What it raises, or an answer that is no dict, is the row's error and its fields are null."""
    names = [x.split()[0] for x in FIELDS.split(", ")]
    keys = list(columns)

    def one(row: dict) -> dict:
        got = model(**row)
        if not isinstance(got, dict):
            raise TypeError(f"the answer is of type {type(got).__name__}")
        return {n: got.get(n) for n in names}

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _tried(one, [dict(zip(keys, r, strict=True)) for r in zip(*b, strict=True)], packing, "fields")

    kinds = ",".join(f"{n}:{t}" for n, t in (x.split() for x in FIELDS.split(", ")))
    return F.pandas_udf(_tuples(run), f"struct<fields:struct<{kinds}>,error:string>")(*columns.values())


def _tuples(run: Callable) -> Callable:
    """run, with the type hints that an iterator UDF of several columns is known by."""

    def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        return run(batches)

    return many


def read_image(image: Column, model: Ocr, packing: Packing = Packing()) -> Column:
    """A struct of `blocks` (text, conf, bbox) and `error` for each image; an image that can't be read has no blocks and its error."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _tried(model, list(b), packing, "blocks")

    return F.pandas_udf(run, f"struct<blocks:{BLOCKS},error:string>")(image)


def backfill_vectors(articles: DataFrame, text: Column, model: Embedder, dim: int = 1024, force: bool = False, packing: Packing = Packing()) -> DataFrame:
    """articles with a vector wherever one was missing (or everywhere); vectors of another length are dropped."""
    ship(articles.sparkSession)
    old = F.when(F.lit(not force) & (F.size("embedding") == dim), F.col("embedding"))
    rows = articles.withColumn("embedding", old)
    missing = rows.where("embedding is null").withColumn("embedding", embed(text, model, packing))
    missing = missing.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")))
    return rows.where("embedding is not null").unionByName(missing)
