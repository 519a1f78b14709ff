"""Numbered folders of features: the next one for a text, and the one that a name means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import title_slug


def next_folders(folders: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, folder) for each text (id, text): a number of at least three digits after the highest that a folder (name) starts with, and the slug of the text's title.

    Several texts are numbered in order of id.
    """
    number = F.regexp_extract("name", r"^\s*([0-9]{1,3})", 1)
    last = folders.agg(F.coalesce(F.max(F.when(number != "", number.cast("int"))), F.lit(0))).first()[0]
    ids = texts.select("id").repartitionByRange("id").withColumn("range", F.spark_partition_id()).groupBy("range").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).alias("n"))
    ranges = ids.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n"))  # a row for each range
    placed = ranges.select("before", F.posexplode("ids").alias("k", "id"))
    return texts.join(placed, "id").select("id", F.concat(F.format_string("%03d", F.col("before") + F.col("k") + last + 1), F.lit("-"), title_slug(F.col("text"))).alias("folder"))


def named_folders(folders: DataFrame, names: DataFrame) -> DataFrame:
    """(name, folder) of the names that mean one folder, in any case: the folder of that name, else the only one that starts with it, else the only one that has it inside.

    Every part of a folder's name is a key, so the two sides meet by an equal join.
    """
    low = F.lower("name")
    cuts = F.expr("flatten(transform(sequence(1, length(low)), i -> transform(sequence(1, length(low) - i + 1), n -> struct(substring(low, i, n) as part, i = 1 as leads, i = 1 and n = length(low) as whole))))")
    parts = folders.filter("name <> ''").select(F.col("name").alias("folder"), low.alias("low")).select("folder", F.explode(cuts).alias("x")).groupBy("folder", "x.part").agg(F.max("x.leads").alias("leads"), F.max("x.whole").alias("whole"))
    met = names.select("name").distinct().withColumn("part", F.lower("name")).join(parts, "part")
    only = lambda test: F.when(F.count(F.when(test, 1)) == 1, F.max(F.when(test, F.col("folder"))))
    found = met.groupBy("name").agg(F.coalesce(F.min(F.when(F.col("whole"), F.col("folder"))), only(F.col("leads")), only(F.lit(True))).alias("folder"))
    return found.filter("folder is not null")
