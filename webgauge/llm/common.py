"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.runtime import discard, scratch_path
from webgauge.runtime import materialize as write_table

__all__ = ["discard", "scratch_path", "write_table"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Default place of a public tokenizer file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def single_threaded() -> None:
    """Keep native libraries from starting a thread per core inside each executor task."""
    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def chunks_by_size(texts: list[str], limit: int):
    """Ranges (lo, hi) of consecutive texts with about ``limit`` characters each; a longer text stands alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def whole_groups(batches, key: str):
    """Batches sorted by ``key`` again, cut only between groups.  Each group has to fit in memory."""
    import pandas as pd

    held = []  # of the last group, which may go on in the next batch
    for pdf in batches:
        if len(pdf):
            last = pdf[key].iloc[-1]
            cut = int((pdf[key] == last).to_numpy().argmax())
            if cut == 0 and held and held[0][key].iloc[-1] == last:
                held.append(pdf)
                continue
            if held or cut:
                yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(keys):
    """(lo, hi) of each run of equal keys in an array."""
    import numpy as np

    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist()
    return zip(at[:-1], at[1:])


#: At most so many keys are hot at once: each holds over a HOT_KEYS-th of all rows.
HOT_KEYS, HOT_LEAST = 512, 1000


def join_to_unique(big: DataFrame, unique: DataFrame, key: str, rows: int) -> DataFrame:
    """``big`` joined with ``unique``, which has one row of each key and n, the key's number of rows in ``big``.

    The rows of hot keys aren't sent to one task: what ``unique`` has for these, at most ``HOT_KEYS`` rows, is broadcast.
    ``rows``: those of ``big`` in all, or more.
    """
    limit = max(HOT_LEAST, rows // HOT_KEYS)
    hot = F.broadcast(unique.where(F.col("n") > limit))
    cold = big.join(hot.select(key), key, "left_anti").join(unique.where(F.col("n") <= limit), key)
    return cold.unionByName(big.join(hot, key))


def join_salted(big: DataFrame, unique: DataFrame, key: str, rows: int, by: str) -> DataFrame:
    """As ``join_to_unique`` for wide rows of ``unique``: hot keys are dealt by a hash of ``by`` to salts, each of which
    gets a copy of the key's row; only names and numbers of hot keys are broadcast."""
    limit = max(HOT_LEAST, rows // HOT_KEYS)
    salts = F.ceil(F.col("n") / limit).cast("int")
    hot = F.broadcast(unique.where(F.col("n") > limit).select(key, salts.alias("__wg_salts")))
    dealt = big.join(hot, key, "left").withColumn("__wg_salt", F.pmod(F.xxhash64(by), F.coalesce("__wg_salts", F.lit(1))).cast("int"))
    copies = unique.withColumn("__wg_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > limit, salts).otherwise(1) - 1)))
    return dealt.drop("__wg_salts").join(copies.drop("n"), [key, "__wg_salt"]).drop("__wg_salt")


SLOTS = 1 << 20


def split_by_slots(big: DataFrame, key, small: DataFrame, small_key) -> tuple[DataFrame, DataFrame]:
    """(rows of ``big`` whose key may occur in ``small``, all other rows), by hash slots.

    The first has all rows that do occur, and a few that share a slot with one.  At most ``SLOTS`` numbers are broadcast
    however large ``small`` is, so wide rows without a partner skip the shuffle of a join.
    """
    slots = F.broadcast(small.select(F.pmod(F.xxhash64(small_key), F.lit(SLOTS)).cast("int").alias("__wg_slot")).distinct())
    numbered = big.withColumn("__wg_slot", F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int"))
    return numbered.join(slots, "__wg_slot", "left_semi").drop("__wg_slot"), numbered.join(slots, "__wg_slot", "left_anti").drop("__wg_slot")


def only_slots_of(big: DataFrame, key, small: DataFrame, small_key) -> DataFrame:
    return split_by_slots(big, key, small, small_key)[0]
