"""Constraints that Parquet doesn't enforce, as reports; deletes that follow foreign keys; entity cards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def duplicates(name: str, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(table, key, n) of key values on several rows."""
    key = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("table"), key.alias("key"), "n")


def orphans(name: str, df: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """(table, column, id) of rows that refer to nothing."""
    rows = df.where(F.col(column).isNotNull()).select("id", F.col(column).alias("_k"))
    return rows.join(parent.select(F.col("id").alias("_k")), "_k", "left_anti").select(F.lit(name).alias("table"), F.lit(column).alias("column"), "id")


def outside(name: str, df: DataFrame, column: str, legal: tuple[str, ...]) -> DataFrame:
    """(table, column, value, n) of values that the column may not have."""
    return df.where(~F.col(column).isin(*legal)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(column).alias("column"), "value", "n")


def delete_meetings(tables: Mapping[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the meetings of ``gone`` (id) and what hangs on them: chunks, runs, mentions, relationships."""
    out = dict(tables)
    out["meetings"] = tables["meetings"].join(gone, "id", "left_anti")
    chunks = tables["meeting_chunks"].join(gone.select(F.col("id").alias("meeting_id")), "meeting_id", "left_semi")
    out["meeting_chunks"] = tables["meeting_chunks"].join(gone.select(F.col("id").alias("meeting_id")), "meeting_id", "left_anti")
    out["mentions"] = tables["mentions"].join(chunks.select(F.col("id").alias("meeting_chunk_id")), "meeting_chunk_id", "left_anti")
    if "extraction_runs" in tables:
        runs = tables["extraction_runs"].join(gone.select(F.col("id").alias("meeting_id")), "meeting_id", "left_semi").select(F.col("id").alias("extraction_run_id"))
        out["extraction_runs"] = tables["extraction_runs"].join(runs.withColumnRenamed("extraction_run_id", "id"), "id", "left_anti")
        out["mentions"] = out["mentions"].join(runs, "extraction_run_id", "left_anti")
        out["relationships"] = tables["relationships"].join(runs, "extraction_run_id", "left_anti")
    return out


def delete_entities(tables: Mapping[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the entities of ``gone`` (id), their aliases, mentions and relationships."""
    out, ids = dict(tables), lambda c: gone.select(F.col("id").alias(c))
    out["entities"] = tables["entities"].join(gone, "id", "left_anti")
    out["entity_aliases"] = tables["entity_aliases"].join(ids("entity_id"), "entity_id", "left_anti")
    out["mentions"] = tables["mentions"].join(ids("entity_id"), "entity_id", "left_anti")
    out["relationships"] = tables["relationships"].join(ids("source_entity_id"), "source_entity_id", "left_anti").join(ids("target_entity_id"), "target_entity_id", "left_anti")
    return out


def entity_cards(entities: DataFrame, aliases: DataFrame, relationships: DataFrame, mentions: DataFrame, first: int = 20) -> DataFrame:
    """(id, name, kind, aliases, relationship_count, mention_rows, first_mentions): a row an entity, ``first`` mentions by id."""
    a = aliases.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("alias")), ", ").alias("aliases"))
    r = relationships.select(F.explode(F.array_distinct(F.array("source_entity_id", "target_entity_id"))).alias("id")).groupBy("id").agg(F.count("*").alias("relationship_count"))
    w = Window.partitionBy("entity_id").orderBy("id")
    shown = mentions.select("id", "entity_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= first)
    m = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mention_rows"))
    s = shown.groupBy(F.col("entity_id").alias("eid")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("first_mentions")).withColumnRenamed("eid", "id")
    rows = entities.select("id", "name", "kind").join(a, "id", "left").join(r, "id", "left").join(m, "id", "left").join(s, "id", "left")
    return rows.fillna(0, ["relationship_count", "mention_rows"])
