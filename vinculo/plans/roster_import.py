"""The roster import: grid cells to records, records into the registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import layouts, merge
from ..operators.scale import materialize


@dataclass
class ImportResult:
    companies: DataFrame
    cities: DataFrame
    employees: DataFrame   # with the action of every row
    salaries: DataFrame
    stats: DataFrame


def sync_records(
    records: DataFrame, companies: DataFrame, cities: DataFrame, employees: DataFrame, salaries: DataFrame,
    now: Column, scope: str = "city",
) -> ImportResult:
    """Dimensions, employees and salaries after the import. The tables read are never overwritten."""

    def names(c: str) -> DataFrame:
        return records.select(F.col(c).alias("nome"), "row_ord")

    company_table, company_ids = merge.upsert_dimension(companies, names("empresa"), now)
    city_table, city_ids = merge.upsert_dimension(cities, names("cidade"), now)
    company_ids, city_ids = materialize(company_ids, "company-ids"), materialize(city_ids, "city-ids")
    keyed = materialize(merge.keyed_records(records, company_ids, city_ids), "keyed-records")
    # Without any known company or city nothing is merged and nothing deactivated.
    reach = city_ids.join(F.broadcast(company_ids.agg((F.count(F.lit(1)) > 0).alias("_any")))).filter("_any").drop("_any")
    merged = materialize(merge.merge_employees(employees, keyed, reach, now, scope), "merged")
    return ImportResult(
        company_table, city_table, merged, merge.upsert_salaries(salaries, keyed, merged),
        merge.sync_stats(merged, company_ids, city_ids, records),
    )


def import_workbooks(
    cells: DataFrame, merges: DataFrame | None, companies: DataFrame, cities: DataFrame, employees: DataFrame,
    salaries: DataFrame, now: Column, layout: str | None = None,
) -> tuple[ImportResult, DataFrame]:
    records, _, rejects = layouts.parse_workbooks(cells, merges, layout)
    return sync_records(records, companies, cities, employees, salaries, now), rejects
