"""Descriptions of entities by a language model: batches, prompts, answers, merging.

The model is a function from prompts to answers that the caller supplies; it runs in
the tasks, and the number of partitions bounds the requests in flight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import last_of_each, let

#: Entities in a request, requests in flight, and attempts.
BATCH_SIZE, IN_FLIGHT, ATTEMPTS = 20, 5, 3


def split_batches(entities: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Add batch: each file's entities (file, position, ...) in order of position, ``size`` to a batch.

    Rows are ranged by file and position, and a range's rows numbered from the counts of
    the file's ranges before it, so that no task orders the whole of a large file.
    """
    from codeloom.sources.scratch import materialise

    columns = entities.columns
    ranged = materialise(entities.repartitionByRange("file", "position").withColumn("_range", F.spark_partition_id()), "ranged-entities")
    counts = ranged.groupBy("file", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("file", "_range", (F.sum("_n").over(Window.partitionBy("file").orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("file", "_range").orderBy("position")) - 1
    placed = ranged.withColumn("_place", place).join(before.withColumnRenamed("file", "_file"), F.col("file").eqNullSafe(F.col("_file")) & (ranged["_range"] == before["_range"]))
    return placed.select(*columns, F.floor((F.col("_before") + F.col("_place")) / size).alias("batch"))


def build_prompt(file: Column, entities: Column) -> Column:
    """The request for an array of struct(name, snippet, known): source texts, the keys to fill, and the rules for the answer.

    Entities of one name, as overloads are, are each shown and share a key. One without a name isn't asked for.
    """
    entities = F.filter(entities, lambda e: e["name"].isNotNull())
    fence = "```"
    blocks = F.array_join(F.transform(entities, lambda e: F.concat(F.lit("### "), e["name"], F.lit(f"\n{fence}\n"), F.coalesce(e["snippet"], F.lit("")), F.lit(f"\n{fence}"))), "\n\n")
    keys = F.to_json(last_of_each(F.transform(entities, lambda e: e["name"]), F.transform(entities, lambda e: F.lit(""))))
    unknown = F.filter(entities, lambda e: e["known"].isNull())
    tests = F.when(F.size(unknown) > 0, F.concat(F.lit("State true or false in \"is_test\" for each of: "), F.to_json(F.array_distinct(F.transform(unknown, lambda e: e["name"]))))).otherwise(F.lit('Leave "is_test" as {}.'))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Describe source code of "), file, F.lit(".")),
        blocks,
        F.lit('Answer with one JSON object that has the keys "descriptions" and "is_test".'),
        F.concat(F.lit("Fill a sentence for each key of \"descriptions\", with the keys unchanged: "), keys),
        tests,
        F.lit("Write JSON alone, without fences, comments or further keys."),
    )


def parse_answer(answer: Column, wanted: Column) -> Column:
    """struct(filled, missing, flags) of an answer and the names asked for; null unless it is a JSON object.

    Descriptions may lie under their key or, flat, at the top. Blank and missing ones are
    missing; only booleans are flags. Of a key that the answer repeats the last value
    counts, and a name that is wanted twice is filled for both.
    """
    none = F.create_map().cast("map<string,string>")

    def read(text: Column) -> Column:
        """The members of one JSON object, null if the text is something else."""
        roots = F.when(text.rlike(r"^\s*\{[\s\S]*\}\s*$"), F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>"))
        return let(roots, lambda r: F.when(F.size(r) == 1, let(r[0], lambda one: F.when(one.isNotNull(), last_of_each(F.map_keys(one), F.map_values(one))))))

    def texts(top: Column) -> Column:
        return let(F.element_at(top, "descriptions"), lambda nested: F.coalesce(F.when(nested.rlike(r"^\s*\{"), read(nested)).otherwise(top), none))

    def named(flat: Column) -> Column:
        names = F.filter(F.array_distinct(wanted), lambda n: n.isNotNull())
        return F.map_filter(F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.trim(F.element_at(flat, n))))), lambda _, v: v.isNotNull() & (v != ""))

    def parsed(top: Column) -> Column:
        marks = F.coalesce(read(F.element_at(top, "is_test")), none)
        flags = F.transform_values(F.map_filter(marks, lambda _, v: v.isin("true", "false")), lambda _, v: v == "true")
        return let(let(texts(top), named), lambda filled: F.struct(filled.alias("filled"), F.filter(wanted, lambda n: ~F.map_contains_key(filled, n)).alias("missing"), flags.alias("flags")))

    return let(read(answer), lambda top: F.when(top.isNotNull(), parsed(top)))


def ask(requests: DataFrame, model: Callable[[list[str]], list[str | None]], in_flight: int = IN_FLIGHT) -> DataFrame:
    """Add answer to rows with a prompt; ``in_flight`` partitions bound the requests under way."""
    schema = requests.withColumn("answer", F.lit(None).cast("string")).schema

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(answer=pd.Series(model(frame["prompt"].tolist()), frame.index, object))

    return requests.repartition(in_flight).mapInPandas(call, schema)


def enrich(entities: DataFrame, model: Callable[[list[str]], list[str | None]], attempts: int = ATTEMPTS, size: int = BATCH_SIZE) -> tuple[DataFrame, DataFrame]:
    """Descriptions (qualified_name, description) and flags (qualified_name, is_test) of entities (file, position, name, snippet, known).

    What an attempt leaves missing is asked again, up to ``attempts`` times.
    """
    from codeloom.sources.scratch import checkpoint

    left, texts, flags = checkpoint(entities), None, None
    for _ in range(attempts):
        one = split_batches(left, size).groupBy("file", "batch").agg(F.array_sort(F.collect_list(F.struct("position", "name", "snippet", "known"))).alias("e"))
        requests = one.select("file", "batch", F.transform("e", lambda x: x["name"]).alias("wanted"), build_prompt(F.col("file"), F.col("e")).alias("prompt"))
        answers = checkpoint(ask(requests, model).withColumn("parsed", parse_answer(F.col("answer"), F.col("wanted"))))
        new_texts = answers.select("file", F.explode("parsed.filled").alias("name", "description"))
        new_flags = answers.select("file", F.explode("parsed.flags").alias("name", "is_test"))
        texts = new_texts if texts is None else texts.unionByName(new_texts)
        flags = new_flags if flags is None else flags.unionByName(new_flags)
        left = checkpoint(left.join(new_texts.select("file", "name").distinct(), ["file", "name"], "left_anti"))
        if left.isEmpty():
            break
    return texts.select(F.col("name").alias("qualified_name"), "description"), flags.select(F.col("name").alias("qualified_name"), "is_test")
