"""Shared shapes: islands, interval joins, ordered folds, vector arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def over(keys: Sequence[str], order: Sequence[str | Column] | None = None) -> WindowSpec:
    spec = Window.partitionBy(*keys)
    return spec.orderBy(*order) if order else spec


def preceding(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    """All rows before this one."""
    return over(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def upto(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    """All rows up to this one."""
    return over(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 0; ``breaks`` (null counts as false) begins a new run. It must not be a window expression."""
    flag = F.coalesce(breaks.cast("int"), F.lit(0))
    return df.withColumn(name, F.sum(flag).over(upto(keys, order)))


def dealt(df: DataFrame, keys: Sequence[str], mb: int = 4) -> DataFrame:
    """``df`` by its keys in as many tasks as its files have shares of ``mb``, at least the usual number: what a task holds doesn't grow with the table, only with its longest key. Tables of unknown size get the usual number."""
    size, usual = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, -(-size // (mb << 20)) if size < 1 << 50 else 0), *keys)


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], *, how: str = "inner", l0: str = "t0", l1: str = "t1", r0: str = "s0", r1: str = "s1", bucket_s: float | None = None) -> DataFrame:
    """Pairs of intervals that overlap. ``bucket_s``: length of time buckets that both sides are dealt to, for recordings too long for one task (inner joins); each pair comes out once, in the bucket where its overlap begins."""
    meet = (F.col(l0) < F.col(r1)) & (F.col(r0) < F.col(l1))
    if bucket_s is None or how != "inner":
        other = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
        return left.join(other, [F.col(k) == F.col(f"r_{k}") for k in keys] + [meet], how).drop(*[f"r_{k}" for k in keys])

    def bucketed(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / bucket_s), F.floor(F.col(b) / bucket_s))))

    both = bucketed(left, l0, l1).join(bucketed(right, r0, r1), [*keys, "bucket"])
    return both.where(meet & (F.col("bucket") == F.floor(F.greatest(F.col(l0), F.col(r0)) / bucket_s))).drop("bucket")


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parts: int | None = None) -> DataFrame:
    """One pass over each key's rows in order, in Python: for accumulations that reset by their own value and so are no window function.

    One shuffle and sort by key; a task then walks through its keys, so that
    many short recordings cost little more than their rows, and holds one
    recording at a time beside the current batch. ``parts``: number of tasks
    where the work is more than the bytes tell, which else decide.
    """
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def same(a: pd.Series, b: pd.Series) -> bool:
            return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a[names], b[names], strict=True))

        def ended() -> list[pd.DataFrame]:
            part = fold((pd.concat(held) if len(held) > 1 else held[0]).reset_index(drop=True))
            held.clear()
            return [part] if len(part) else []

        for batch in batches:
            if not len(batch):
                continue
            out = ended() if held and not same(held[-1].iloc[-1], batch.iloc[0]) else []
            code = batch.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
            starts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1), len(batch)]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                held.append(batch.iloc[lo:hi])
                if hi < len(batch):
                    out += ended()
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield from ended()

    by_key = df.repartition(*names) if parts is None else df.repartition(parts, *names)
    return by_key.sortWithinPartitions(*names, *order).mapInPandas(run, schema)


def ordered_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Callable[[dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """As ``ordered_fold`` over plain values: ``fold`` gets a key's columns as lists (null numbers of double columns as NaN) and gives rows. One Arrow batch goes out for each that comes in, however many keys it holds."""
    names, types = list(keys), to_arrow_schema(StructType.fromDDL(schema))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, types, strict=True)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        current = None
        for batch in batches:
            columns = {f.name: c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(f.type) else c.to_pylist() for f, c in zip(batch.schema, batch.columns, strict=True)}
            rows, lo, each = [], 0, list(zip(*[columns[k] for k in names], strict=True))
            for hi in range(1, len(each) + 1):
                if hi < len(each) and each[hi] == each[lo]:
                    continue
                part = {k: v[lo:hi] for k, v in columns.items()}
                if held and each[lo] == current:
                    for k, v in part.items():
                        held[k] += v
                else:
                    rows += fold(held) if held else []
                    held, current = part, each[lo]
                lo = hi
            if rows:
                yield out(rows)
        if held:
            yield out(fold(held))

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInArrow(run, schema)
