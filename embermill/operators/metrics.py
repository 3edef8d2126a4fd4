"""Counters: their text form, sums over label sets, differences between two scrapes, and tallies of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the counters, by provider and content type.
COUNTERS = ("hits", "misses", "prompt_tokens")


def counters(reconciled: DataFrame, fetched: DataFrame) -> DataFrame:
    """hits, misses and prompt_tokens by provider and content_type; no owner, by design.  fetched has the two labels and
    prompt_tokens, summed over calls."""
    by = ["provider", "content_type"]
    seen = reconciled.groupBy(*by).agg(F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"))
    billed = fetched.groupBy(*by).agg(F.sum("prompt_tokens").alias("prompt_tokens"))
    return seen.join(billed, by, "left").select(*by, "hits", "misses", F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"))


def metrics_text(metrics: DataFrame) -> DataFrame:
    """Lines of the Prometheus text format, one for each counter that the frame has and each pair of labels."""
    lines = [F.format_string(f'memo_{name}_total{{content_type="%s",provider="%s"}} %d', "content_type", "provider", name) for name in COUNTERS if name in metrics.columns]
    return metrics.select(F.explode(F.array(*lines)).alias("value"))


def parsed(lines: DataFrame) -> DataFrame:
    """family, labels (a map) and value of the sample lines of a scrape (column value); other lines are left out."""
    line = F.col("value")
    labels = F.regexp_extract(line, r"\{([^}]*)\}", 1)
    pairs = F.transform(F.filter(F.split(labels, r',(?=[A-Za-z_]+=")'), lambda x: x != ""), lambda x: F.struct(F.regexp_extract(x, "^([^=]+)=", 1).alias("k"), F.regexp_extract(x, '="(.*)"$', 1).alias("v")))
    number = F.regexp_extract(line, r"\}\s+([0-9.eE+-]+)\s*$", 1).try_cast("double")
    return lines.where(line.rlike(r"^[A-Za-z_:][A-Za-z0-9_:]*\{") & number.isNotNull()).select(F.regexp_extract(line, r"^([^{]+)", 1).alias("family"), F.map_from_entries(pairs).alias("labels"), number.alias("value"))


def sum_metric(lines: DataFrame, family: str, **labels: str) -> DataFrame:
    """The sum of a family over all label sets that have these labels; 0 where there is none."""
    found = parsed(lines).where(F.col("family") == family)
    for name, wanted in labels.items():
        found = found.where(F.element_at("labels", name) == wanted)
    return found.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


def delta(scrapes: DataFrame, order: str = "scrape") -> DataFrame:
    """For every family and label set the increase since the scrape before; a label set that was not there counts from 0."""
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    flat = scrapes.withColumn("label_set", key)
    earlier = flat.select("family", "label_set", (F.col(order) + 1).alias(order), F.col("value").alias("earlier"))
    return flat.join(earlier, ["family", "label_set", order], "left").select("family", "label_set", order, (F.col("value") - F.coalesce("earlier", F.lit(0.0))).alias("increase"))


def tally(checks: DataFrame) -> DataFrame:
    """How many checks passed and failed."""
    return checks.agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))
