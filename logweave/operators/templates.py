"""Template aggregation, counts over events and the join of template attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import ids, text

STATIC = ("service_name", "severity_text", "severity_number", "normalized_template", "error_kind", "exception_type", "issue_kind")
_STATUS = ("ok", "degraded", "failed")


def filled(c: str) -> Column:
    """Null where empty."""
    return F.when(F.col(c) != "", F.col(c))


def partial_templates(events: DataFrame, static: Sequence[str] = STATIC) -> DataFrame:
    """Aggregates of templates that can be merged with those of other events: counts, time texts, the first event by (source, offset), the worst status."""
    seen = F.coalesce(filled("timestamp"), filled("observed_timestamp"))
    worst = F.max(F.coalesce(F.array_position(F.array(*map(F.lit, _STATUS)), F.col("parse_status")), F.lit(0)))
    first = F.min(F.struct("source", "offset", "event_id", *static))
    # what has no template is left out behind the aggregation: a filter in front would be pushed into the expressions that compute the id
    g = events.groupBy("template_id").agg(F.max("template_id").alias("_any"), F.count(F.lit(1)).alias("event_count"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), first.alias("f"), worst.alias("w"))
    return g.where("_any is not null").drop("_any")


def merge_templates(partials: DataFrame) -> DataFrame:
    """Partial aggregates of the same templates as one."""
    return partials.groupBy("template_id").agg(F.sum("event_count").alias("event_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("f").alias("f"), F.max("w").alias("w"))


def aggregate_templates(events: DataFrame, static: Sequence[str] = STATIC) -> DataFrame:
    """One row per template: event_count, first and last time text, the static columns and the id of its first event in file order, the worst parse status.

    Times are texts and compared as such; empty ones do not count.  Events
    without template are left out.  Combined on the map side, so a template
    with a third of all events is no hot task.
    """
    return finished_templates(partial_templates(events, static), static)


def finished_templates(partials: DataFrame, static: Sequence[str] = STATIC) -> DataFrame:
    """Templates of merged partial aggregates."""
    status = F.coalesce(F.try_element_at(F.array(*map(F.lit, _STATUS)), F.when(F.col("w") > 0, F.col("w").cast("int"))), F.lit("ok"))
    return partials.select("template_id", "event_count", "first_seen", "last_seen", F.col("f.event_id").alias("example_event_id"), *[F.col(f"f.{c}").alias(c) for c in static], status.alias("parse_status"))


def top_templates(templates: DataFrame, n: int = 20) -> DataFrame:
    return templates.orderBy(F.desc("event_count"), "template_id").limit(n)


def identify(events: DataFrame, body: str = "body") -> DataFrame:
    """Add normalized_template, headline, template_id, exception_type and error_kind computed from the body.

    A text of one line is normalised once; of several lines the headline is
    that of the first, so a traceback below it does not change the id.
    """
    df = text.with_normalized(events.drop("normalized_template", "template_id", "headline", "exception_type", "error_kind"), body)
    several = F.col(body).contains("\n")
    df = df.withColumn("_line", F.when(several, text.normalized(text.first_line(F.col(body)))).otherwise(F.col("normalized_template")))
    df = df.withColumn("headline", text.cut_headline(F.col("_line"))).withColumn("exception_type", text.exception_type(F.col(body)))
    df = df.withColumn("error_kind", text.error_kind(F.col(body), F.col("severity_text"), F.col("exception_type")))
    return df.withColumn("template_id", ids.template_id(F.col("service_name"), F.col("severity_text"), F.col("headline"))).drop("_line")


def value_counts(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) of several columns in one pass over the events (grouping sets); null values are counted."""
    sets = [[c] for c in columns]
    which = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns]).alias("column_name")
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in columns]).alias("value")
    return events.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(which, value, F.count(F.lit(1)).alias("n")).select("column_name", "value", "n")


def runtime_counts(events: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row of exact distinct counts; null, empty and ``-`` are no values."""
    real = lambda c: F.when(~F.trim(F.col(c).cast("string")).isin("", "-"), F.col(c))
    return events.agg(*[F.count_distinct(real(c)).alias(name) for name, c in columns.items()])


def with_template_attributes(events: DataFrame, templates: DataFrame, attributes: dict[str, str | None]) -> DataFrame:
    """Left join of template attributes on template_id; a missing template takes the default given."""
    right = templates.select(F.col("template_id").alias("_tid"), *[F.col(c).alias(f"_t_{c}") for c in attributes])
    joined = events.drop(*attributes).join(right, F.col("template_id") == F.col("_tid"), "left")
    keep = [F.col(f"`{c}`") for c in events.columns if c not in attributes]
    return joined.select(*keep, *[F.coalesce(F.col(f"_t_{c}"), F.lit(d)).alias(c) for c, d in attributes.items()])


def remap_templates(events: DataFrame, remap: DataFrame) -> DataFrame:
    """Events moved to their canonical template (template_id, canonical_template_id); identity where there is none."""
    r = remap.select(F.col("template_id").alias("_tid"), F.col("canonical_template_id").alias("_to"))
    return events.join(r, F.col("template_id") == F.col("_tid"), "left").withColumn("template_id", F.coalesce("_to", "template_id")).drop("_tid", "_to")
