"""Writes on keyed tables, as DataFrames: every function returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The federal units and their names.
STATES = {
    "AC": "Acre", "AL": "Alagoas", "AP": "Amapá", "AM": "Amazonas", "BA": "Bahia", "CE": "Ceará", "DF": "Distrito Federal", "ES": "Espírito Santo",
    "GO": "Goiás", "MA": "Maranhão", "MT": "Mato Grosso", "MS": "Mato Grosso do Sul", "MG": "Minas Gerais", "PA": "Pará", "PB": "Paraíba",
    "PR": "Paraná", "PE": "Pernambuco", "PI": "Piauí", "RJ": "Rio de Janeiro", "RN": "Rio Grande do Norte", "RS": "Rio Grande do Sul",
    "RO": "Rondônia", "RR": "Roraima", "SC": "Santa Catarina", "SP": "São Paulo", "SE": "Sergipe", "TO": "Tocantins",
}


def scan(table: DataFrame, columns: list[str], **equal) -> DataFrame:
    """Some columns of the rows that equal given values; both reach the files' reader."""
    for name, value in equal.items():
        table = table.where(F.col(name) == value)
    return table.select(*columns)


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, rows after the table's own; a row of rows replaces the whole row.

    Only one struct for each key and task is shuffled: the latest row is a partial aggregate, so that a key with very many rows does no harm.
    """
    columns = table.columns
    both = table.withColumns({"_new": F.lit(0), "_at": F.struct(F.lit(0))}).select(*columns, "_new", F.lit(None).cast(rows.select(F.struct(*order)).schema[0].dataType).alias("_at"))
    new = rows.withColumn("_new", F.lit(1)).withColumn("_at", F.struct(*order)).select(*columns, "_new", "_at")
    last = both.unionByName(new).groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct("_new", "_at")).alias("_row"))
    return last.select("_row.*")


def insert_missing(table: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The table and, of rows whose key it lacks, the first of each key."""
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*table.columns), F.struct(*order)).alias("_row")).select("_row.*")
    return table.unionByName(first.join(table.select(*key), key, "left_anti"))


def delete(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key), key, "left_anti")


def update(table: DataFrame, patch: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Columns set where the key (unique in patch) matches; also to null."""
    new = patch.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(new, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def write_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that rows has, and no others. Rows are rebalanced by the key, so that a very large partition gets several tasks."""
    rows.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def state_seed(spark: SparkSession, base_url: str = "https://example.org/uf") -> DataFrame:
    """The dimension of states: 27 rows."""
    return spark.createDataFrame([(uf, name, f"{base_url}/{uf.lower()}") for uf, name in STATES.items()], "uf string, nome string, pagina_url string")


def orphans(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Facts whose key the dimension lacks (null refers to nothing and is none)."""
    return facts.where(F.col(key).isNotNull()).join(dimension.select(key), key, "left_anti")


def cascade(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Facts that stay once the rows of all keys that the dimension lacks are gone."""
    return facts.join(dimension.select(key), key, "left_semi")


def violations(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, rows: how many rows break each rule; a rule that is null for a row is kept by it."""
    counts = table.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules])).alias("x")).select("x.*")


def quarantine(table: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of those they break."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    marked = table.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
