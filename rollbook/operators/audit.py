"""Audits: the failures that look like success."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(rows: DataFrame, identity: list[str]) -> DataFrame:
    """How often an identity usually occurs: the mode of the counts, of equal ones the larger."""
    counts = rows.groupBy(*identity).agg(F.count("*").alias("n"))
    return counts.groupBy("n").agg(F.count("*").alias("identities")).orderBy(F.desc("identities"), F.desc("n")).limit(1).select(F.col("n").alias("fold"))


def _unpivoted(rows: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    return rows.select(*keep, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(keep, columns, "field", "value")


def numeric_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, numeric): every value that is not blank is digits, commas aside; none is not."""
    value = F.regexp_replace(F.trim("value"), ",", "")
    return _unpivoted(rows, [], columns).where("trim(value) != ''").groupBy("field").agg(F.bool_and(value.rlike(r"^\d+$")).alias("numeric"))


def responsive(rows: DataFrame, period: str, columns: list[str]) -> DataFrame:
    """(field, responsive): the field's total differs between periods. Totals are rounded sums."""
    totals = rows.groupBy(period).agg(*(F.round(F.sum(c), 6).alias(c) for c in columns))
    return totals.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "field", "total").groupBy("field").agg((F.count_distinct("total") > 1).alias("responsive"))


def absent(rows: DataFrame, period: str, fields: Column) -> DataFrame:
    """(field, period) pairs that occur in no record, for fields and periods that occur. fields:
    an array column of the fields a record has."""
    seen = rows.select(F.col(period).alias("period"), F.explode(fields).alias("field")).distinct()
    # both sides are the small dimensions of a panel: fields and periods, not records
    grid = seen.select("field").distinct().join(F.broadcast(rows.select(F.col(period).alias("period")).distinct()), F.lit(True))
    return grid.join(seen, ["field", "period"], "left_anti")


def audit(rows: DataFrame, period: str, identity: list[str]) -> DataFrame:
    """rows, distinct identities and their ratio, by period."""
    return rows.groupBy(period).agg(F.count("*").alias("rows"), F.count_distinct(*identity).alias("distinct_rows")).withColumn("folded", F.col("rows") > F.col("distinct_rows"))


def saturation(known: DataFrame, got: DataFrame, key: str, partial: bool = False) -> DataFrame:
    """known, got, new, recall (of an empty first pass: 0) and saturated."""
    a = known.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    b = got.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full")
    out = both.agg(F.count("_a").alias("known"), F.count("_b").alias("got"), F.count(F.when(F.col("_a").isNull(), 1)).alias("new"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("common"))
    recall = F.when(F.col("known") > 0, F.col("common") / F.col("known")).otherwise(0.0)
    return out.select("known", "got", "new", F.round(recall, 6).alias("recall"), ((F.col("new") == 0) & F.lit(not partial)).alias("saturated"))


def unmapped(offered: Column, mapped: Column) -> Column:
    """Different non-blank names that are offered but not mapped, in order."""
    named = F.array_distinct(F.filter(F.transform(offered, lambda x: F.trim(x)), lambda x: x != ""))
    return F.array_except(named, mapped)


def require_coverage(offered: list[str], mapped: list[str], source: str) -> None:
    """Both directions; a gap is an error that names both lists."""
    named = [x.strip() for x in offered if x and x.strip()]
    extra, missing = [x for x in dict.fromkeys(named) if x not in mapped], [x for x in mapped if x not in named]
    if extra or missing:
        raise ValueError(f"{source}: unmapped {extra}, missing {missing}")


def assert_finds(rows: DataFrame, control: Column, what: str) -> DataFrame:
    """The rows, once a known record is seen among them."""
    if rows.where(control).limit(1).isEmpty():
        raise ValueError(f"positive control not found: {what}")
    return rows


def catalogue_floor(rows: DataFrame, label: str, least: int) -> DataFrame:
    """The rows of a catalogue, unless there are fewer than `least` or a label occurs twice: a short
    answer is a changed source, and a repeated label would lose a row. A null label is one label."""
    told = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.min(F.when(F.col("n") > 1, F.coalesce(F.col(label).cast("string"), F.lit("null")))).alias("twice")).first()
    if (told["rows"] or 0) < least:
        raise ValueError(f"{told['rows'] or 0} rows, fewer than {least}")
    if told["twice"] is not None:
        raise ValueError(f"label occurs twice: {told['twice']}")
    return rows


def declared(rows: DataFrame, unit: list[str], total: Column, repeated: Column | None = None) -> DataFrame:
    """yielded and complete of each unit: enough for the declared total; unknown when undeclared;
    False where a page was repeated, declared or not."""
    repeated = F.lit(False) if repeated is None else repeated
    out = rows.groupBy(*unit).agg(F.count("*").alias("yielded"), F.max(total).alias("declared"), F.max(repeated).alias("repeated"))
    complete = F.when(F.col("repeated"), False).when(F.col("declared").isNotNull(), F.col("yielded") >= F.col("declared"))
    return out.withColumn("complete", complete).drop("repeated")


def repeated_pages(rows: DataFrame, page: str, key: str, series: list[str] = ()) -> DataFrame:
    """Pages whose set of ids is that of the page before. The set is compared by a hash of the
    sorted ids: a page is bounded by its request."""
    sets = rows.groupBy(*series, page).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), ","), 256).alias("_ids"))
    w = Window.partitionBy(*series).orderBy(page)
    return sets.withColumn("repeated", F.coalesce(F.lag("_ids").over(w) == F.col("_ids"), F.lit(False))).drop("_ids")


def bleed(rows: DataFrame, key: str, text: str, subject: str, series: list[str], order: str) -> DataFrame:
    """Rows whose last line is the subject of the next row of their series."""
    last = F.trim(F.element_at(F.split(F.trim(F.col(text)), "\n"), -1))
    following = F.trim(F.lead(subject).over(Window.partitionBy(*series).orderBy(order)))
    return rows.withColumn("_last", last).withColumn("_next", following).where("_next != '' AND _last = _next").drop("_last", "_next")


def parse_status(bleeds: Column, stated: Column, parsed: Column) -> Column:
    """Bleed first, then a missing total, then a mismatch."""
    return F.when(bleeds > 0, "boundary_bleed").when(stated.isNull(), "no_stated_total").when(stated != parsed, "count_mismatch").otherwise("reconciled")


def run_status(attempts: DataFrame, run: str, failed: Column) -> DataFrame:
    """failed, partial or complete by how many buckets failed."""
    out = attempts.groupBy(run).agg(F.count("*").alias("buckets"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failed"))
    status = F.when(F.col("failed") == 0, "complete").when(F.col("failed") == F.col("buckets"), "failed").otherwise("partial")
    return out.withColumn("status", status)


def counts_by(rows: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """One column for each status, zero where there is none."""
    return rows.groupBy(key).agg(*(F.count_if(F.col(status) == v).alias(v) for v in values))


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, checked, failed) of every rule; an unknown outcome is a failure."""
    sums = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    wide = rows.agg(F.count("*").alias("checked"), *sums)
    return wide.unpivot(["checked"], list(rules), "rule", "failed").select("rule", "checked", "failed")


def partial_units(rows: DataFrame, unit: list[str], failed: Column, capped: Column, smallest: Column) -> DataFrame:
    return rows.groupBy(*unit).agg(F.bool_or(F.coalesce(failed | (capped & smallest), F.lit(False))).alias("partial"))


def recheck(now: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """changed, unchanged or unknown, with the reason, of digests against the latest archived."""
    latest = archive.groupBy(key).agg(F.max_by("digest", "archived_at").alias("archived_digest"))
    out = now.join(latest, key, "left")
    reason = F.when(F.col("digest").isNull(), "no_digest").when(F.col("archived_digest").isNull(), "never_archived")
    return out.withColumn("changed", F.when(reason.isNull(), F.col("digest") != F.col("archived_digest"))).withColumn("reason", reason)


def named(offered: Column) -> Column:
    """Different names that are not blank, in order."""
    return F.array_distinct(F.filter(F.transform(offered, lambda x: F.trim(x)), lambda x: x != ""))


def sample_ids(ids: Column, most: int = 50) -> Column:
    """The first different ids in order, for a report."""
    return F.slice(F.array_sort(F.collect_set(ids.cast("string"))), 1, most)


def collected(units: DataFrame, unit: str, value: Column, error: Column) -> DataFrame:
    """One row: values, failed (units), partial, and the first failed units in order."""
    out = units.agg(F.count_if(error.isNull() & value.isNotNull()).alias("values"), F.count_if(error.isNotNull()).alias("failed"), sample_ids(F.when(error.isNotNull(), F.col(unit))).alias("failed_units"))
    return out.withColumn("partial", F.col("failed") > 0)
