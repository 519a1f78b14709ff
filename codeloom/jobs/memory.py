"""Compression of conversations, for many at once: when, up to where, and with what text.

``messages`` has conv_id, turn, role and text, and may have tool_calls (array of
struct(name, arguments)). Positions count from 0 in the order of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Per cent of the context that triggers, per cent of the text that is folded, characters to a token, fewest messages.
TRIGGER, FOLD, CHARS_PER_TOKEN, FEWEST = 50, 70, 4, 5

#: Parts of model names with the tokens of their context windows; the first that fits counts.
WINDOWS = (
    (("gpt-4.1", "gpt4.1"), 1_047_576), (("gpt-5", "gpt5"), 400_000), (("gpt-4o", "gpt4o"), 128_000), (("gpt-4", "gpt4"), 128_000),
    (("gpt-3.5", "gpt3.5", "gpt-3"), 16_385), (("o1", "o3", "o4"), 200_000),
    (("claude&4.6", "claude&4-6"), 1_000_000), (("claude&4.5", "claude&4-5"), 1_000_000), (("claude",), 200_000),
    (("gemini-2", "gemini2"), 1_048_000), (("gemini",), 128_000), (("gemma",), 128_000), (("deepseek",), 64_000), (("qwen",), 131_072),
    (("mistral-nemo", "mistralnemo"), 128_000), (("mistral", "mixtral"), 32_000), (("llama",), 131_072), (("phi-4", "phi4"), 16_000),
)
DEFAULT_WINDOW = 128_000
#: What leads the message that stands for the folded ones, before and after their number.
COMPRESSED = ("[Summary of the ", " messages before this one]")


def context_window(model: Column) -> Column:
    """Tokens of a model's context window by its name, in any case."""
    name = F.lower(model)
    out = F.lit(DEFAULT_WINDOW)
    for parts, tokens in reversed(WINDOWS):
        fits = F.lit(False)
        for part in parts:
            both = F.lit(True)
            for piece in part.split("&"):
                both = both & F.contains(name, F.lit(piece))
            fits = fits | both
        out = F.when(fits, tokens).otherwise(out)
    return out


def compression_threshold(tokens: Column) -> Column:
    return F.floor(tokens * TRIGGER / 100) * CHARS_PER_TOKEN


def char_count(messages: DataFrame) -> Column:
    """Bytes of the text and of the tool calls' names and arguments."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    if "tool_calls" in messages.columns:
        size = size + F.coalesce(F.aggregate("tool_calls", F.lit(0).cast("long"), lambda a, c: a + F.octet_length(c["name"]) + F.octet_length(c["arguments"])), F.lit(0))
    return size


def counted(messages: DataFrame) -> DataFrame:
    """Add chars, position and n (messages of the conversation)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return messages.withColumns({"chars": char_count(messages), "position": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("conv_id"))})


def should_compress(messages: DataFrame, threshold: int) -> DataFrame:
    """(conv_id, n, chars, compress): five messages at least, and more bytes than the threshold."""
    sums = messages.withColumn("chars", char_count(messages)).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    return sums.withColumn("compress", (F.col("n") >= FEWEST) & (F.col("chars") > threshold))


def compression_boundary(messages: DataFrame) -> DataFrame:
    """(conv_id, boundary): the first position that stays, so that positions 1 to boundary - 1 are folded.

    The first message and the last two stay. Messages are folded until their bytes reach
    the fold share of what may be folded, and one at least.
    """
    inner = counted(messages).filter((F.col("position") >= 1) & (F.col("position") < F.greatest(F.col("n") - 2, F.lit(1))))
    so_far = F.sum("chars").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("chars").over(Window.partitionBy("conv_id"))
    reached = inner.withColumns({"so_far": so_far, "target": F.floor(total * FOLD / 100)}).filter("so_far >= target")
    return reached.groupBy("conv_id").agg((F.min("position") + 1).cast("long").alias("boundary"))


def transcripts(messages: DataFrame) -> DataFrame:
    """(conv_id, transcript) of what is folded, each message led by its role; system messages leave an empty line."""
    folded = counted(messages).join(compression_boundary(messages), "conv_id").filter("position >= 1 and position < boundary")
    text = F.coalesce("text", F.lit(""))
    calls = F.array_join(F.transform("tool_calls", lambda c: c["name"]), ", ") if "tool_calls" in messages.columns else F.lit("")
    assistant = F.when(calls != "", F.concat(F.lit("[Assistant called tools]: "), calls)).otherwise(F.concat(F.lit("[Assistant]: "), text))
    line = F.when(F.col("role") == "user", F.concat(F.lit("[User]: "), text)).when(F.col("role") == "assistant", assistant).when(F.col("role") == "tool", F.concat(F.lit("[Tool result]: "), text))
    entry = F.concat(F.coalesce(F.concat(line, F.lit("\n")), F.lit("")), F.lit("\n"))
    return folded.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", entry.alias("e")))), lambda x: x["e"]), "").alias("transcript"))


def apply_compression(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Replace what is folded by one user message with (conv_id, summary); other conversations stay."""
    bounds = compression_boundary(messages).join(summaries, "conv_id")
    placed = counted(messages).join(bounds, "conv_id", "left")
    folded = F.coalesce((F.col("position") >= 1) & (F.col("position") < F.col("boundary")), F.lit(False))
    head = F.concat(F.lit(COMPRESSED[0]), (F.col("boundary") - 1).cast("string"), F.lit(COMPRESSED[1] + "\n\n"), F.col("summary"))
    kept = placed.filter(~folded).select(*messages.columns)
    first = placed.filter(folded & (F.col("position") == 1))
    return kept.unionByName(first.withColumns({"role": F.lit("user"), "text": head}).select(*(F.lit(None).cast(messages.schema[c].dataType).alias(c) if c == "tool_calls" else F.col(c) for c in messages.columns)))
