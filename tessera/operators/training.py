"""Training-data preparation: token shards, masks, interleaving, replay, resumable cursors."""

from __future__ import annotations

import math

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a training sequence.
SEQ_LEN = 4096


def token_lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, white-space words standing in for an injected tokenizer's tokens."""
    return docs.withColumn("n_tokens", F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("bigint"))


def running_offset(docs: DataFrame, order: list[str], size: str = "n_tokens", part_rows: int = 100_000) -> DataFrame:
    """``docs`` with the number of tokens before each row in the given order, without one global window.

    Rows are range-partitioned by the order; each partition sums inside, and the totals of the partitions
    before it (one row per partition) are added.
    """
    parts = docs.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    totals = parts.groupBy("_p").agg(F.sum(size).alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("token_offset", (F.col("_in") + F.col("_before")).cast("bigint")).drop("_p", "_in", "_before")


def shard_of(offset: Column, shard_tokens: int, seq_len: int) -> Column:
    """Shard number of a token offset; shards hold whole sequences."""
    return F.floor(offset / (shard_tokens // seq_len * seq_len))


def shard_totals(docs: DataFrame, seq_len: int, shard_tokens: int, batch: int = 1) -> DataFrame:
    """One row: tokens kept (the tail under a sequence is dropped), sequences, shards, steps per epoch."""
    per = shard_tokens // seq_len
    n = F.sum("n_tokens")
    seqs = F.floor(n / seq_len)
    return docs.agg((seqs * seq_len).alias("tokens"), seqs.alias("sequences"), F.ceil(seqs / per).alias("shards"), F.floor(seqs / batch).alias("steps_per_epoch"))


def masks(examples: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """(.., n_prompt, n_completion) after cutting prompt and completion to ``seq_len``; rows without completion tokens go."""
    p = F.least("n_prompt", F.lit(seq_len))
    c = F.least("n_completion", F.lit(seq_len) - p)
    return examples.withColumns({"kept_prompt": p, "kept_completion": c}).where("kept_completion > 0")


def mask_array(prompt: Column, completion: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(0), prompt.cast("int")), F.array_repeat(F.lit(1), completion.cast("int")))


def every(ratio: float) -> int:
    """Batches between two supervised ones; 0 for none."""
    return max(1, round(1 / ratio)) if ratio > 0 else 0


def interleave(batches: DataFrame, n_examples: int, ratio: float, number: str = "batch_no") -> DataFrame:
    """Each batch with the supervised example that follows it, or null; examples cycle. Closed form, so it resumes anywhere."""
    k = every(ratio)
    if not k or not n_examples:
        return batches.withColumn("sft_example", F.lit(None).cast("bigint"))
    due = F.pmod(F.col(number) + 1, F.lit(k)) == 0
    return batches.withColumn("sft_example", F.when(due, F.pmod(F.floor((F.col(number) + 1) / k) - 1, F.lit(n_examples))))


def replay_count(n_domain: int, ratio: float) -> int:
    return int(n_domain * ratio / (1 - ratio)) if ratio < 1 else 0


def replay_mix(domain: DataFrame, replay: DataFrame, key: str, ratio: float = 0.25, seed: int = 42) -> DataFrame:
    """Domain rows and a share of replay rows, drawn by hash order (with replacement where there are too few), in hash order."""
    want = replay_count(domain.count(), ratio)
    have = max(1, replay.count())
    times = math.ceil(want / have) if want else 0
    drawn = replay.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(max(1, times))))) if want else replay.withColumn("_copy", F.lit(1)).limit(0)
    drawn = drawn.orderBy("_copy", F.xxhash64(F.lit(seed), key)).limit(want).drop("_copy").withColumn("origin", F.lit("replay"))
    return domain.withColumn("origin", F.lit("domain")).unionByName(drawn).withColumn("position", F.xxhash64(F.lit(seed + 1), key, "origin"))


def validation_split(rows: DataFrame, key: str, fraction: float = 0.1, least: int = 10) -> DataFrame:
    """``rows`` with a role; the hash of the key decides, nothing is held out of fewer than ``least``."""
    small = rows.count() < least
    held = F.lit(False) if small else F.pmod(F.crc32(F.col(key).cast("string")), F.lit(1000)) < int(fraction * 1000)
    return rows.withColumn("role", F.when(held, "validation").otherwise("train"))


def after_cursor(shards: DataFrame, shard: int, offset: int) -> DataFrame:
    """Sequences after a (shard, offset) cursor; the one consumed last isn't repeated."""
    return shards.where((F.col("shard_id") > shard) | ((F.col("shard_id") == shard) & (F.col("seq_no") > offset)))


def shuffled_order(shards: DataFrame, seed: int) -> DataFrame:
    """Rank of each shard in a seeded order, sequences in place."""
    order = shards.select("shard_id").distinct().withColumn("turn", F.dense_rank().over(Window.orderBy(F.xxhash64(F.lit(seed), "shard_id"), "shard_id")))
    return shards.join(F.broadcast(order), "shard_id")


def cosine_rate(step: Column, base: float, warmup: int, total: int) -> Column:
    progress = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    return F.when(step < warmup, base * (step + 1) / warmup).otherwise(0.5 * base * (1 + F.cos(F.pi() * progress)))


def resume_continuous(before: Column, after: Column, tolerance: float = 0.15) -> Column:
    """Whether mean losses before and after a resume agree within ``tolerance``."""
    return F.try_divide(F.abs(after - before), F.abs(before)) <= tolerance


def bits_per_character(losses: DataFrame, by: str) -> DataFrame:
    """(by, n_chars, bits_per_char): summed loss in nats over summed characters, in bits; null without characters."""
    out = losses.groupBy(by).agg(F.sum("n_chars").alias("n_chars"), F.sum("loss_nats").alias("loss"))
    return out.select(by, "n_chars", F.try_divide(F.col("loss") / math.log(2), F.col("n_chars")).alias("bits_per_char"))


def throughput(steps: DataFrame, by: str, warmup: int = 1) -> DataFrame:
    """(by, n_steps, tokens, tokens_per_second, median_seconds) of steps (by, step, tokens, seconds) after the first ``warmup``."""
    timed = steps.where(F.col("step") >= warmup)
    out = timed.groupBy(by).agg(F.count(F.lit(1)).alias("n_steps"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"), F.median("seconds").alias("median_seconds"))
    return out.select(by, "n_steps", "tokens", F.try_divide(F.col("tokens"), F.col("seconds")).alias("tokens_per_second"), "median_seconds")
