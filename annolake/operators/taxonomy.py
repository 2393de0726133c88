"""Label taxonomies: merging records of one triple, canonical names, graph nodes and edges, siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.functions.text import strip
from annolake.operators.ranks import total_rank

#: Numbers from which new ids are given, and the length at which merged text is cut.
FIRST_NEW, LONGEST = 133, 2000


def catalog_number(c: Column) -> Column:
    """n of 'INT-n', and 10^9 for other ids."""
    return F.coalesce(F.regexp_extract(c, r"^INT-(\d{1,18})$", 1).try_cast("bigint"), F.lit(10**9))


def free_numbers(lacking: DataFrame, used: DataFrame, order: list[str], bucket: list[str]) -> DataFrame:
    """lacking with column `k`: in the order given, the numbers from FIRST_NEW on that `used` (k) does not have.

    The r-th free number is as far from the r-th number at all as there are used ones below it, and a used number is below it if fewer than r free ones are below that. So both
    are put in one order and counted, in buckets of their values.
    """
    span = 10_000
    ranked = total_rank(lacking, bucket, order, "_r")
    known = used.filter(F.col("k") >= FIRST_NEW).select("k").distinct().withColumn("_b", F.floor(F.col("k") / span))
    below = total_rank(known, ["_b"], ["k"], "_j").select((F.col("k") - FIRST_NEW - F.col("_j") + 1).alias("_r"))
    both = ranked.withColumn("_used", F.lit(0)).unionByName(below.withColumn("_used", F.lit(1)), allowMissingColumns=True).withColumn("_b", F.floor(F.col("_r") / span))
    sums = both.groupBy("_b").agg(F.sum("_used").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("_used").over(Window.partitionBy("_b").orderBy("_r", F.col("_used")).rowsBetween(Window.unboundedPreceding, 0))
    counted = both.withColumn("_own", own).join(sums.select("_b", before.alias("_before")), "_b").filter("_used = 0")
    return counted.select(*lacking.columns, (F.col("_r") + FIRST_NEW - 1 + F.col("_own") + F.col("_before")).alias("k"))


def merge_triples(df: DataFrame, texts: list[str]) -> DataFrame:
    """One row per complete triple (l1, l2, l3) of df (id, name, ord, *texts): members, the primary's id, name, and merged texts; and new_id.

    The primary is the member with the least catalog number, then provisional ids (AUTO-), then others, by ord. A triple whose primary has no catalog
    id gets the next number from FIRST_NEW on that no member anywhere uses, in the order of triples. Rows with a blank level are left out.
    Equal texts of a triple are folded before they are put together, and no more are than the cut text has room for; so a triple may have any number of rows.
    """
    triple = ["l1", "l2", "l3"]
    whole = df.filter(" and ".join(f"coalesce({c}, '') <> ''" for c in triple))
    number = catalog_number(F.col("id"))
    kind = F.when(number < 10**9, 0).when(F.col("id").startswith("AUTO-"), 1).otherwise(2)
    place = F.struct(kind.alias("kind"), number.alias("number"), "ord", "id", "name")
    merged = whole.groupBy(*triple).agg(F.count("*").alias("members"), F.min(place).alias("first"))
    merged = merged.select(*triple, "members", F.col("first.id").alias("primary_id"), F.col("first.number").alias("number"), F.col("first.name").alias("name"))
    parts = F.array(*(F.struct(F.lit(t).alias("field"), strip(F.coalesce(t, F.lit(""))).alias("text")) for t in texts))
    each = whole.select(*triple, F.struct(kind.alias("kind"), number.alias("number"), "ord").alias("at"), F.explode_outer(parts).alias("p")).select(*triple, "at", "p.*").filter("text <> ''")
    once = each.groupBy(*triple, "field", "text").agg(F.min("at").alias("at"))
    room = LONGEST // (len(" | ") + 1) + 1  # a text has a letter and its mark at least
    few = once.withColumn("r", F.row_number().over(Window.partitionBy(*triple, "field").orderBy("at"))).filter(F.col("r") <= room)
    put = lambda t: F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == t, F.struct("r", "text")))), lambda x: x.text), " | "), 1, LONGEST).alias(t)
    merged = merged.join(few.groupBy(*triple).agg(*map(put, texts)), triple, "left")
    lacking = merged.filter(f"number = {10**9}").select(*triple, F.substring("l3", 1, 2).alias("_p"))
    given = free_numbers(lacking, whole.select(number.alias("k")).filter(f"k < {10**9}"), triple, ["l1", "l2", "_p"]).select(*triple, F.concat(F.lit("INT-"), F.col("k").cast("string")).alias("given"))
    return merged.join(given, triple, "left").select(*triple, "members", "primary_id", F.coalesce("given", "primary_id").alias("new_id"), "name", *(F.coalesce(t, F.lit("")).alias(t) for t in texts))


def graph(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, level, name), edges (source, target)) of the triples of df (domain, l1, l2, l3, id): root, domain, l1, l2, l3 and intent, each once."""
    path = [("root", F.lit("root"), F.lit("root")), *((c, F.concat(F.lit(f"{c}:"), F.col(c)), F.col(c)) for c in ("domain", "l1", "l2", "l3")), ("intent", F.concat(F.lit("intent:"), F.col("id")), F.col("id"))]
    nodes = F.array(*(F.struct(i.alias("node_id"), F.lit(level).alias("level"), name.alias("name")) for level, i, name in path))
    edges = F.array(*(F.struct(a[1].alias("source"), b[1].alias("target")) for a, b in zip(path, path[1:])))
    return df.select(F.inline(nodes)).distinct(), df.select(F.inline(edges)).distinct()


def siblings(df: DataFrame, most: int) -> DataFrame:
    """df (id, l2, l3) with `siblings`: up to `most` other l3 of the same l2, by id, blank ones dropped after the limit. A parent's first most + 1 rows are enough for all its rows."""
    few = df.withColumn("_r", F.row_number().over(Window.partitionBy("l2").orderBy("id"))).filter(F.col("_r") <= most + 1)
    heads = few.groupBy("l2").agg(F.array_sort(F.collect_list(F.struct("id", "l3"))).alias("_heads"))
    others = F.slice(F.filter("_heads", lambda h: h.id != F.col("id")), 1, most)
    return df.join(heads, "l2").withColumn("siblings", F.filter(F.transform(others, lambda h: h.l3), lambda x: F.coalesce(x, F.lit("")) != "")).drop("_heads")


def canonical_names(known: DataFrame, name: str, normal: Column) -> DataFrame:
    """(key, canonical): the least name of each normal form."""
    return known.groupBy(normal.alias("key")).agg(F.min(name).alias("canonical")).filter("key is not null")
