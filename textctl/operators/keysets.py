"""Key sets as bitmaps.

Prompts are numbered once within their task (``ids.row_numbers``). A set of
prompts is then a bitmap over these numbers, 4 KB per 32,768 prompts, and the
answers of a (task, model, aspect, iteration) are one row per such bucket.
Bitmaps are built map-side and merged by ``bitmap_or_agg``: within a run, and
over the runs of a log, whose bitmaps can be kept instead of its keys.
What is missing is the difference of two bitmaps. No request key is shuffled
to find it: a request that is there costs a bit, and only buckets with a gap
are expanded to keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import join_small
from ..sources.registry import sql_str, suffix_py
from .ids import row_numbers

SET = ["task", "model", "aspect", "iter"]
#: Bits of one bitmap of Spark's bitmap functions.
BITS = 32_768


def numbered(master: DataFrame) -> DataFrame:
    """(task, prompt_id, number) of the distinct prompts, from 1 within a
    task. Rows with a null key are in no set, as they match no result."""
    keys = master.select("task", "prompt_id").where(F.col("task").isNotNull() & F.col("prompt_id").isNotNull()).distinct()
    return row_numbers(keys, ["task"], "prompt_id", out="_rank").select("task", "prompt_id", (F.col("_rank") + 1).alias("number"))


def _bits(numbers: DataFrame, by: list[str]) -> DataFrame:
    number = F.col("number")
    return numbers.groupBy(*by, F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def held(results: DataFrame, numbers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bitmaps of the prompts that ``results`` hold; results without a prompt
    are in none, repeated results set the same bit."""
    by = by or SET
    return _bits(join_small(results.select(*by, "prompt_id"), numbers, ["task", "prompt_id"]), by)


def merged(bitmaps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One bitmap per set and bucket of the bitmaps of several runs."""
    return bitmaps.groupBy(*(by or SET), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def wanted(numbers: DataFrame, models: list[tuple[int, str]], iters: int, aspects) -> DataFrame:
    """The bitmaps of all prompts, for every model, aspect and iteration."""
    sets = ", ".join(f"named_struct('model', {sql_str(suffix_py(m))}, 'aspect', {sql_str(a)}, 'iter', {i})" for _, m in models for a in aspects for i in range(iters))
    every = _bits(numbers, ["task"])
    return every.select("task", "bucket", F.col("bits").alias("all_bits"), F.explode(F.expr(f"array({sets})")).alias("s")).select("task", "s.*", "bucket", "all_bits")


def gaps(want: DataFrame, have: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The buckets of ``want`` that ``have`` does not fill, with ``n_missing``."""
    on = [*(by or SET), "bucket"]
    n_held = F.coalesce(F.bitmap_count("bits"), F.lit(0))  # a subset of all_bits
    x = want.join(have, on, "left").withColumn("n_missing", F.bitmap_count("all_bits") - n_held)
    return x.where(F.col("n_missing") > 0)


def _word(bits: Column, i: Column) -> Column:
    """The i-th four bytes as a number."""
    return F.conv(F.hex(F.substring(bits, 4 * i + 1, F.lit(4))), 16, 10).cast("long")


def missing_numbers(gap: DataFrame) -> DataFrame:
    """The rows of ``gaps`` as numbers of prompts: in ``all_bits``, not in
    ``bits``."""
    words = F.transform(
        F.sequence(F.lit(0), F.lit(BITS // 32 - 1)),
        lambda i: F.struct(
            i.alias("at"),
            F.when(F.col("bits").isNull(), _word(F.col("all_bits"), i))
            .otherwise(_word(F.col("all_bits"), i).bitwiseAND(F.bitwise_not(_word(F.col("bits"), i))))
            .alias("word"),
        ),
    )
    keep = [c for c in gap.columns if c not in ("bits", "all_bits", "n_missing")]
    x = gap.select(*keep, F.explode(F.filter(words, lambda w: w["word"] != 0)).alias("w"))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.expr("w.word").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) != 0))
    x = x.select(*keep, "w.at", bit.alias("b"))
    # bytes in order, bits of a byte from the lowest
    position = F.expr("at * 32 + 8 * (3 - b div 8) + b % 8")
    return x.select(*[c for c in keep if c != "bucket"], ((F.col("bucket") - 1) * BITS + position + 1).alias("number"))


def pending(master: DataFrame, models: list[tuple[int, str]], finished: DataFrame, iters: int, aspects) -> DataFrame:
    """The request keys (task, model, prompt_id, aspect, iter) without a
    finished result. Equals the anti join of all request keys with the
    finished ones."""
    numbers = numbered(master)
    gap = gaps(wanted(numbers, models, iters, aspects), held(finished, numbers))
    return join_small(missing_numbers(gap), numbers, ["task", "number"]).select("task", "model", "prompt_id", "aspect", "iter")


def fill(master: DataFrame, models: list[tuple[int, str]], finished: DataFrame, iters: int, aspects) -> DataFrame:
    """Per task, model, aspect and iteration how many of the
    prompts have a result (``n_prompts``, ``n_held``); sets without any
    result are there with 0."""
    numbers = numbered(master)
    x = wanted(numbers, models, iters, aspects).join(held(finished, numbers), [*SET, "bucket"], "left")
    count = lambda c: F.coalesce(F.sum(F.bitmap_count(c)), F.lit(0))
    return x.groupBy(*SET).agg(count("all_bits").alias("n_prompts"), count("bits").alias("n_held"))
