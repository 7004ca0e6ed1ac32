"""Queries over the composite plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import BALANCE_COLUMNS, raw_samples, samples
from ..plans import report
from ..plans.acquire import acquire_source
from ..session import workspace
from ..sources import tables
from ..sources.vendors import SOURCES
from .ingest import _vendor_sheet
from .registry import IBE_SQL, register


@register("""SELECT 'Part_' || CAST(database_number AS STRING) AS "Database_name", count(*) AS n_part, count(*) AS n_merged, TRUE AS matches
  FROM raw GROUP BY 1""")
def consolidate(spark, d):
    raw = raw_samples(spark, d)
    parts = {f"Part_{i}": acquire_source(_vendor_sheet(raw.where(F.col("database_number") == i)), SOURCES["MDPI_Tibet"]) for i in range(1, 14)}
    return report.consolidate(spark, parts, workspace(spark, "consolidated"), "2025-01-01_00-00-00").reconciliation


@register("""SELECT sample_id, ibe FROM ibe WHERE abs(ibe) <= 5 AND (temperature >= 10 OR temperature IS NULL)""", IBE_SQL)
def quality_filter(spark, d):
    root = workspace(spark, "acquired")
    tables.write_snapshot(samples(spark, d), root, "2025-01-01_00-00-00")
    done = report.quality_filter(spark, root, workspace(spark, "filtered"), "2025-01-02_00-00-00", BALANCE_COLUMNS, "temperature")
    return done.table.select("sample_id", "ibe")


@register("""SELECT 'column' AS part, "column" AS name, n_values AS n FROM (SELECT 'period' AS "column", count(period) AS n_values FROM samples
  UNION ALL SELECT 'location', count(location) FROM samples UNION ALL SELECT 'na', count(na) FROM samples UNION ALL SELECT 'ph', count(ph) FROM samples
  UNION ALL SELECT 'sampled_at', count(sampled_at) FROM samples)
  UNION ALL SELECT 'number', 'na', count(na) FROM samples UNION ALL SELECT 'number', 'ph', count(ph) FROM samples
  UNION ALL SELECT 'period', period, count(*) FROM samples WHERE period IS NOT NULL GROUP BY period
  UNION ALL SELECT 'year', CAST(year(sampled_at) AS STRING), count(*) FROM samples GROUP BY 2
  UNION ALL SELECT 'fixed', CAST(least(floor(ph / 0.5e0), 27)::INT AS STRING), count(*) FROM samples WHERE ph BETWEEN 0 AND 14 GROUP BY 2
  UNION ALL SELECT 'rows', CAST(g.b AS STRING), count(f.bin) FROM range(10) g(b) LEFT JOIN (SELECT greatest(2 * (
      CASE WHEN period IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN location IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN na IS NOT NULL THEN 1 ELSE 0 END
      + CASE WHEN ph IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN sampled_at IS NOT NULL THEN 1 ELSE 0 END) - 1, 0) AS bin FROM samples) f
    ON f.bin = g.b GROUP BY g.b""")
def profile_report_tables(spark, d):
    tables_ = report.profile_report_tables(samples(spark, d).select("period", "location", "na", "ph", "sampled_at"), ["na", "ph"], ["period"],
                                           fixed={"ph": (0.0, 14.0, 28)}, dates=["sampled_at"])
    part = lambda df, label, name, n: df.select(F.lit(label).alias("part"), F.col(name).cast("string").alias("name"), F.col(n).alias("n"))
    return (part(tables_.columns, "column", "column", "n_values").unionByName(part(tables_.numbers, "number", "feature", "n_values"))
            .unionByName(part(tables_.categories["period"], "period", "category", "n"))
            .unionByName(part(tables_.years["sampled_at"], "year", "year", "n")).unionByName(part(tables_.fixed_bins["ph"], "fixed", "bin", "n"))
            .unionByName(part(tables_.rows, "rows", "bin", "n")))
