"""Roster into registry: dimensions, employees, salaries, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PAYROLL_MONEY_FIELDS
from ..functions.fold import fold_name
from ..functions.roster import bank_of_contract, compare_fold

KEY = ["empresa_id", "municipio_id", "nome_normalizado"]
MERGED = ("banco", "contrato", "observacoes", "codigo")
ACTIONS = ("insert", "update", "reactivate", "unchanged", "deactivate", "untouched")


def upsert_dimension(existing: DataFrame, names: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """J-14. (new table, map): names whose fold is not there yet are added once, with the fold's hash as id.

    ``names(nome, row_ord)``; of equal folds the first name is stored. Where the
    table already has one fold twice, the map takes the id of the row created last.
    """
    fresh = (
        names.filter("nome <> ''").withColumn("nome_normalizado", fold_name(F.col("nome")))
        .groupBy("nome_normalizado").agg(F.min_by("nome", F.struct("row_ord", "nome")).alias("nome"))
    )
    added = fresh.join(existing.select("nome_normalizado"), "nome_normalizado", "left_anti").select(
        F.sha2("nome_normalizado", 256).alias("id"), "nome", "nome_normalizado", now.alias("created_at")
    )
    table = existing.select("id", "nome", "nome_normalizado", "created_at").unionByName(added)
    ids = table.groupBy("nome_normalizado").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
    return table, ids.join(fresh.select("nome_normalizado"), "nome_normalizado", "left_semi")


def keyed_records(records: DataFrame, companies: DataFrame, cities: DataFrame) -> DataFrame:
    """Records with their registry key; records of unknown company or city are left out."""
    return (
        records.withColumns(
            {
                "_e": fold_name(F.col("empresa")), "_m": fold_name(F.col("cidade")),
                "nome_normalizado": fold_name(F.col("colaborador")),
            }
        )
        .join(companies.select(F.col("nome_normalizado").alias("_e"), F.col("id").alias("empresa_id")), "_e")
        .join(cities.select(F.col("nome_normalizado").alias("_m"), F.col("id").alias("municipio_id")), "_m")
        .withColumn("banco", F.coalesce(F.nullif(F.col("banco"), F.lit("")), bank_of_contract(F.col("contrato"))))
        .drop("_e", "_m")
    )


def incoming_by_key(keyed: DataFrame) -> DataFrame:
    """One row per key: the first record for an insert, the last for an update, and how many there were."""
    order = F.col("row_ord")
    value = F.struct("colaborador", *MERGED)
    return keyed.groupBy(*KEY).agg(
        F.min_by(value, order).alias("first_rec"), F.max_by(value, order).alias("last_rec"),
        F.count(F.lit(1)).alias("copies"),
    )


def merge_employees(
    registry: DataFrame, keyed: DataFrame, cities: DataFrame, now: Column, scope: str = "city"
) -> DataFrame:
    """J-15, U-2. The registry after the import, with an ``action`` per row.

    A record with a known key updates bank, contract, notes and code when one of
    them differs after S-24, and reactivates an inactive row; a record with a new
    key is inserted; an active row of an uploaded city without a record is
    deactivated. ``scope='company_city'`` only deactivates rows whose company
    was uploaded for the city too. Keys are unique on both sides, so the one full
    outer join has no hot key. No row is ever removed.
    """
    incoming = incoming_by_key(keyed)
    joined = registry.alias("o").join(incoming.alias("n"), KEY, "full")
    old, rec = F.col("o.id").isNotNull(), F.col("n.copies").isNotNull()
    same = F.lit(True)
    for f in MERGED:
        same = same & compare_fold(F.col(f"n.last_rec.{f}")).eqNullSafe(compare_fold(F.col(f"o.{f}")))
    if scope == "city":
        reach = cities.select(F.col("id").alias("municipio_id")).distinct()
        on = ["municipio_id"]
    elif scope == "company_city":
        reach = keyed.select("empresa_id", "municipio_id").distinct()
        on = ["empresa_id", "municipio_id"]
    else:
        raise ValueError("scope is 'city' or 'company_city'")
    merged = joined.join(reach.withColumn("_reached", F.lit(True)), on, "left")
    active = F.col("o.ativo")
    action = (
        F.when(~old, "insert")
        .when(rec & ~active, "reactivate")
        .when(rec & ~same, "update")
        .when(rec, "unchanged")
        .when(active & F.col("_reached"), "deactivate")
        .otherwise("untouched")
    )
    merged = merged.withColumn("action", action)
    written = F.col("action").isin("update", "reactivate")

    def value(f: str, blank_to_null: bool) -> Column:
        clean = (lambda c: F.nullif(c, F.lit(""))) if blank_to_null else (lambda c: c)
        return (
            F.when(F.col("action") == "insert", clean(F.col(f"n.first_rec.{f}")))
            .when(written, clean(F.col(f"n.last_rec.{f}")))
            .otherwise(F.col(f"o.{f}"))
            .alias(f)
        )

    new_id = F.sha2(F.concat_ws("|", *KEY), 256)
    touched = F.col("action").isin("insert", "update", "reactivate", "deactivate")
    return merged.select(
        F.coalesce("o.id", new_id).alias("id"), *KEY,
        F.coalesce("o.nome", F.col("n.first_rec.colaborador")).alias("nome"), F.col("o.cargo").alias("cargo"),
        value("banco", False), value("contrato", False), value("codigo", True), value("observacoes", True),
        F.when(F.col("action").isin("insert", "update", "reactivate"), True)
        .when(F.col("action") == "deactivate", False).otherwise(active).alias("ativo"),
        F.coalesce("o.created_at", now).alias("created_at"),
        F.when(touched, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
        "action", F.coalesce("n.copies", F.lit(0)).alias("copies"),
    )


def sync_stats(merged: DataFrame, companies: DataFrame, cities: DataFrame, keyed_total: DataFrame) -> DataFrame:
    """A-4. One row of counts; updates count intended writes, reactivations included."""
    acts = merged.agg(
        F.count_if(F.col("action") == "insert").alias("novos"),
        F.count_if(F.col("action").isin("update", "reactivate")).alias("atualizados"),
        F.count_if(F.col("action") == "deactivate").alias("removidos"),
        F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("copies") - 1)), F.lit(0)).alias("duplicados"),
    )
    one = lambda df, name: F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))  # noqa: E731  (one row each)
    return (
        acts.join(one(companies, "empresas")).join(one(cities, "municipios")).join(one(keyed_total, "total"))
        .select("empresas", "municipios", "novos", "atualizados", "removidos", "total", "duplicados")
    )


def upsert_salaries(salaries: DataFrame, keyed: DataFrame, merged: DataFrame) -> DataFrame:
    """J-16. Salary rows of the import replace those of the same employee; only records with a salary count."""
    latest = keyed.filter("salario is not null").groupBy(*KEY).agg(
        F.max_by(F.struct(*PAYROLL_MONEY_FIELDS), "row_ord").alias("s")
    )
    fresh = latest.join(merged.select("id", *KEY), KEY).select(F.col("id").alias("funcionario_id"), "s.*")
    kept = salaries.join(fresh.select("funcionario_id"), "funcionario_id", "left_anti")
    return kept.select("funcionario_id", *PAYROLL_MONEY_FIELDS).unionByName(fresh)


def delete_employees(registry: DataFrame, salaries: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-17. Both tables without the given ids."""
    return (
        registry.join(ids.select("id"), "id", "left_anti"),
        salaries.join(ids.select(F.col("id").alias("funcionario_id")), "funcionario_id", "left_anti"),
    )
