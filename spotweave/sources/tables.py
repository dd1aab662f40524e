"""Reading and writing the tables of the model."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.checks import InputError, require_columns, require_none, require_rows
from spotweave.functions.scalars import gene_key
from spotweave.operators.sizefactor import SAMPLE
from spotweave.session import shared_dir

# Columns that sample metadata must have.
METADATA_COLUMNS = [
    "dataset_title", "id", "image_filename", "organ", "species", "patient", "st_technology", "spots_under_tissue", "nb_genes",
]

# Built-in gene sets of published marker genes (fixed values).
DEFAULT_GENE_SETS = {
    "epithelial_tumor": ["EPCAM", "KRT7", "KRT8", "KRT18", "KRT19", "MUC1", "ERBB2", "MSLN"],
    "pan_immune": ["PTPRC", "LST1", "LYZ", "CD68", "CD3D", "CD3E", "CD8A", "MS4A1"],
    "t_cell": ["CD3D", "CD3E", "CD2", "CD247", "TRAC", "CD8A", "CD4"],
    "b_cell": ["MS4A1", "CD79A", "CD79B", "CD74", "BANK1"],
    "myeloid": ["LYZ", "LST1", "CD68", "FCGR3A", "S100A8", "S100A9"],
    "stromal_ecm": ["COL1A1", "COL1A2", "COL3A1", "DCN", "LUM", "VIM", "ACTA2", "TAGLN"],
    "endothelial": ["PECAM1", "VWF", "KDR", "ENG", "PLVAP", "RAMP2"],
    "proliferation": ["MKI67", "TOP2A", "PCNA", "UBE2C", "CENPF"],
    "hypoxia_stress": ["VEGFA", "CA9", "LDHA", "ENO1", "HIF1A", "BNIP3", "NDRG1"],
    "interferon_response": ["ISG15", "IFIT1", "IFIT3", "MX1", "OAS1", "STAT1", "CXCL10"],
}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, visible to every executor."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def number_or_null(c) -> F.col:
    return c.try_cast("double")


def read_csv(spark: SparkSession, path: str | list[str], required: list[str], what: str) -> DataFrame:
    """All columns as text: types are a decision of the caller, and no inference pass over the data is needed."""
    return require_columns(spark.read.csv(path, header=True), required, what)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    d = read_csv(spark, path, METADATA_COLUMNS, "sample metadata")
    return d.withColumn("spots_under_tissue", number_or_null(F.col("spots_under_tissue"))).withColumn(
        "nb_genes", number_or_null(F.col("nb_genes"))
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ["sample_id", "split", "features_path", "counts_path"], "manifest")


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """One gene per line in list order; unusable keys are dropped. A gene list is one file of bounded size, read whole."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "gene"))
    kept = lines.withColumn("gene", gene_key(F.col("gene"))).filter("gene IS NOT NULL")
    packed = kept.agg(F.array_sort(F.collect_list(F.struct("line", "gene"))).alias("g"))
    return packed.select(F.posexplode("g").alias("gene_index", "s")).select(F.col("s.gene").alias("gene"), "gene_index")


def read_gene_indices(spark: SparkSession, path: str) -> DataFrame:
    """(gene_index, position), one whole number per line in list order; blank lines count for nothing, other text is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    lines = lines.withColumn("value", F.trim("value")).filter("value <> ''").withColumn("gene_index", F.col("value").try_cast("bigint"))
    require_none(lines.filter("gene_index IS NULL").select("value"), f"{path} has lines that are no numbers")
    packed = lines.agg(F.array_sort(F.collect_list(F.struct("line", "gene_index"))).alias("g"))  # one file of bounded size
    return packed.select(F.posexplode("g").alias("position", "s")).select("s.gene_index", "position")


def selected_genes(spark: SparkSession, names_path: str | None = None, indices_path: str | None = None) -> DataFrame | None:
    if names_path and indices_path:
        raise InputError("give gene names or gene indices, not both")
    if names_path:
        return read_gene_list(spark, names_path)
    if indices_path:
        return read_gene_indices(spark, indices_path)
    return None


def read_gene_sets(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(signature, gene, position in the file or files, from 0); built-in sets without a path."""
    if path is None:
        rows = [(s, g, i) for s, genes in DEFAULT_GENE_SETS.items() for i, g in enumerate(genes)]
        return spark.createDataFrame(rows, "signature string, gene string, position int")
    from spotweave.operators.ordering import row_number

    d = read_csv(spark, path, ["signature", "gene"], "gene-set table")
    # A block of a file is read in order by one task; the order of blocks is that of the files, however they are dealt over tasks.
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    d = row_number(d.withColumn("_place", place), [], [F.col("_place")], "position").withColumn("position", F.col("position") - 1).drop("_place")
    return require_rows(clean_gene_sets(d), f"no gene sets in {path}")


def clean_gene_sets(d: DataFrame) -> DataFrame:
    return d.withColumn("gene", F.trim("gene")).filter("gene <> '' AND signature IS NOT NULL").orderBy("signature", "position")


def clean_cell_type_map(d: DataFrame) -> DataFrame:
    require_columns(d, ["cell_type", "signature"], "cell-type map")
    d = d.withColumn("cell_type", F.trim("cell_type")).withColumn("signature", F.trim("signature"))
    return require_rows(d.filter("cell_type <> '' AND signature <> ''").dropDuplicates(["cell_type", "signature"]), "no usable cell types")


def choose_prediction_source(candidates: DataFrame) -> DataFrame:
    """Of the places where a prediction may lie, the first that exists, per (sample, kind).

    `candidates` holds (sample_id, kind, priority, location, found).
    """
    return (
        candidates.filter("found")
        .groupBy(SAMPLE, "kind")
        .agg(F.min_by("location", "priority").alias("location"), F.min("priority").alias("priority"))
    )


def counts_to_long(dense: DataFrame, genes: DataFrame, values: str = "values") -> DataFrame:
    """One row per non-zero entry of a count vector, its gene looked up by position."""
    long = dense.select(SAMPLE, "spot_id", F.posexplode(values).alias("gene_index", "count")).filter("count <> 0")
    return long.join(genes.select("gene", "gene_index"), "gene_index").select(SAMPLE, "spot_id", "gene", "count")


def write_size_factors(sf: DataFrame, path: str) -> None:
    """One folder per sample is what readers prune on; rows of a sample stay in as many files as tasks hold them."""
    sf.write.mode("overwrite").partitionBy("split").parquet(path)


def write_splits(splits: DataFrame, path: str) -> None:
    splits.write.mode("overwrite").partitionBy("split_type").csv(path, header=True)


def write_marts(marts: dict[str, DataFrame], path: str) -> dict[str, str]:
    out = {}
    for name, df in marts.items():
        out[name] = f"{path}/{name}"
        df.write.mode("overwrite").parquet(out[name])
    return out


def read_run_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """Summary tables of all runs under a glob, with the run's name and path of origin."""
    d = spark.read.csv(pattern, header=True)
    p = F.col("_metadata.file_path")
    return d.select("*", F.regexp_extract(p, "([^/]+)/summary\\.csv", 1).alias("run_name"), p.alias("source_path"))


def spot_table(features: DataFrame, coords: DataFrame, counts: DataFrame, stored_sf: DataFrame | None = None, min_total: float = 1.0) -> DataFrame:
    """Features, coordinates, totals and size factors of every spot. Spots that only one side knows are an error."""
    from spotweave.checks import row_count_mismatches
    from spotweave.operators.sizefactor import SPOT, size_factor, spot_totals, stored_size_factor

    require_none(row_count_mismatches(features, coords, SPOT, SAMPLE), "features and coordinates disagree on the spots")
    base = features.join(coords.select(*SPOT, "x", "y"), SPOT)
    totals = spot_totals(base, counts)
    if stored_sf is None:
        return size_factor(totals, min_total)
    return stored_size_factor(totals.join(stored_sf.select(*SPOT, "stored_sf"), SPOT, "left"), "stored_sf", min_total).drop("stored_sf")
