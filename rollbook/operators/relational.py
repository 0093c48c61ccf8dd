"""Relational operators over manifests: DataFrame in, DataFrame out, no action inside.

Row order is never implied: where the first or last row counts, a position column says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_children(parents: DataFrame, children: DataFrame, key: str, position: str, as_: str = "children") -> DataFrame:
    """Every parent with its children as an array in order of position; none is an empty array."""
    fields = [c for c in children.columns if c != key]
    item = F.struct(F.col(position).alias("_at"), F.struct(*fields).alias("row"))
    lists = children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.row).alias(as_))
    kind = lists.schema[as_].dataType
    return parents.join(lists, key, "left").withColumn(as_, F.coalesce(as_, F.array().cast(kind)))


def last_row(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key. Where a table is large, max_by keeps this to one partial
    aggregation instead of a sort; use `last_value` for that."""
    w = Window.partitionBy(*key).orderBy(*[F.col(o).desc() if isinstance(o, str) else o.desc() for o in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_row(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by a stated order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def compact(rows: DataFrame, key: list[str], order: list[str], of_kind: Column) -> DataFrame:
    """The last row of each key for one kind; other kinds' repeated keys are history and stay."""
    kind = F.coalesce(of_kind, F.lit(False))
    return last_row(rows.where(kind), key, order).unionByName(rows.where(~kind))


def last_value(rows: DataFrame, key: list[str], value: str, order: list[str], as_: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(as_))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_slice(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """All old rows of the slices that `new` holds go, whatever their keys."""
    return upsert(old, new, [column])


def unseen(rows: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(seen.select(*key).distinct(), key, "left_anti")


def status_changes(rows: DataFrame, key: list[str], status: str, order: list[str]) -> DataFrame:
    """Rows whose status differs from the one before, the first of each key among them."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_before", F.lag(status).over(w)).where(~F.col("_before").eqNullSafe(F.col(status))).drop("_before")


def top(rows: DataFrame, key: str, n: int, measure: Column | None = None, as_: str = "n") -> DataFrame:
    """The n largest keys by a measure; ties in order of the key."""
    measure = F.count("*") if measure is None else measure
    return rows.groupBy(key).agg(measure.alias(as_)).orderBy(F.desc(as_), key).limit(n)


def fallback(first: DataFrame, second: DataFrame, unit: list[str]) -> DataFrame:
    """The second source's rows only for units of which the first returned nothing."""
    return first.unionByName(second.join(first.select(*unit).distinct(), unit, "left_anti"), allowMissingColumns=True)


def prefer(rows: DataFrame, unit: list[str], preferred: Column) -> DataFrame:
    """The preferred rows of a unit if it has any, else all of its rows."""
    some = F.max(F.coalesce(preferred, F.lit(False))).over(Window.partitionBy(*unit))
    return rows.withColumn("_some", some).where(~F.col("_some") | F.coalesce(preferred, F.lit(False))).drop("_some")


def chain(reports: DataFrame, links: DataFrame, answers: DataFrame, observations: DataFrame) -> DataFrame:
    """For each action-taken report: its link (the last counts), the original report it refers to
    (only if that is no action-taken report itself), its answers, and the original's observations,
    which are looked up by the referenced key even where the original is missing."""
    link = last_row(links, ["atr_key"], ["position"]).select(F.col("atr_key").alias("key"), "references_report_key")
    taken = reports.where("report_type = 'action_taken'")
    original = reports.where("report_type != 'action_taken'").select(F.col("key").alias("references_report_key"), F.struct(*reports.columns).alias("original"))
    out = with_children(taken.join(link, "key", "left").join(original, "references_report_key", "left"), answers, "key", "position", "answers")
    return with_children(out, observations.withColumnRenamed("key", "references_report_key"), "references_report_key", "position", "observations")


def evidence(records: DataFrame, answers: DataFrame, ministry: str, terms: list[str]) -> DataFrame:
    """Records of a ministry whose own text, or any of whose answers', holds a term."""
    from rollbook.functions.text import contains_any

    joined = with_children(records, answers, "key", "position", "answers")
    said = F.array_join(F.transform("answers", lambda a: F.concat_ws(" ", a["question_text"], a["answer_text"])), " ")
    return joined.where(F.upper("ministry").contains(ministry.upper()) & contains_any(F.concat_ws(" ", "title", "ministry", said), terms))


def bundle(**families: DataFrame) -> DataFrame:
    """Several families of records side by side, each row with its family's name."""
    out = None
    for name, rows in families.items():
        rows = rows.withColumn("family", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def search_plan(profile: DataFrame, most: int | None = None) -> DataFrame:
    """(position, group, query) of a profile's map<string, array<string>> groups."""
    pairs = profile.select(F.posexplode(F.map_entries("groups")).alias("g", "entry")).select("g", F.col("entry.key").alias("group"), F.posexplode("entry.value").alias("q", "query"))
    plan = pairs.withColumn("position", F.row_number().over(Window.orderBy("g", "q")) - 1).select("position", "group", "query")
    return plan if most is None else plan.where(F.col("position") < most)


def merge_entities(rows: DataFrame) -> DataFrame:
    """One row for each entity_id: its first canonical name and all other names, sorted."""
    names = rows.groupBy("entity_id").agg(F.min_by("canonical_name", "first_seen_at").alias("canonical_name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_append("alt_names", F.col("canonical_name")))))).alias("alt_names"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_updated_at").alias("last_updated_at"))
    return names.withColumn("alt_names", F.array_except("alt_names", F.array("canonical_name")))


def topic_filter(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """The rows with `kept`: a predicate on titles comes before one on whole records, and what
    either leaves out is no match."""
    title = F.coalesce(before, F.lit(False))
    return rows.withColumn("kept", F.when(title, F.coalesce(after, F.lit(False))).otherwise(False))


def of_type(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    return rows.where(F.lower(F.trim(column)) == wanted.strip().lower())


def braked(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first `most` rows in a stated order."""
    return rows.orderBy(*order).limit(most)


def united(queries: list[DataFrame], key: list[str]) -> DataFrame:
    """The results of several queries, each key once, from the first query that has it."""
    out = None
    for i, rows in enumerate(queries):
        rows = rows.withColumn("_query", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return first_row(out, key, ["_query"]).drop("_query")


def year_over_year(spend: DataFrame, company: str) -> DataFrame:
    """financial_year, amount and the change since the year before, of one company."""
    years = spend.where(F.col("company") == company).groupBy("financial_year").agg(F.sum(F.col("amount").cast("decimal(20,4)")).alias("amount"))
    change = F.col("amount") - F.lag("amount").over(Window.orderBy("financial_year"))  # a row for each year
    return years.select("financial_year", F.col("amount").cast("double").alias("amount"), change.cast("double").alias("change"))
