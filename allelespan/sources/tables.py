"""Lookup tables from the text and JSON files they are published in."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from allelespan.fixed_values import SEVERE_PHENOTYPES
from allelespan.functions.associations import gwas_rsid, risk_allele
from allelespan.functions.clinical import significance_terms
from allelespan.functions.contigs import gwas_chrom, is_score_chrom, normalize_chrom
from allelespan.functions.numbers import blank_to_null, to_double, to_long
from allelespan.schemas import SEED_FILES, SITE_KEY

# Column numbers (from 0) of the association catalogue's download.
GWAS_PLACES = {
    "pubmed_id": 1,
    "first_author": 2,
    "trait": 7,
    "chrom": 11,
    "pos": 12,
    "mapped_gene": 14,
    "risk_allele": 20,
    "rsid": 21,
    "risk_allele_freq": 26,
    "p_value": 27,
    "or_beta": 30,
    "ci_text": 31,
    "mapped_trait": 34,
    "study_accession": 36,
}
GWAS_MIN_COLUMNS = 35
QUOTED_CELL = '\t("(?:[^"]++|"")*+"(?=\t|$)|[^\t]*+)'


def read_seed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A seed TSV: ``#`` lines skipped, header checked against the schema, ``.`` and blank read as NULL.

    A value that is not of its column's type, or a wrong header, fails the job.
    """
    schema = SEED_FILES[table]
    rows = spark.read.csv(
        path, sep="\t", comment="#", header=True, schema=schema, enforceSchema=False, nullValue=".", mode="FAILFAST"
    )
    rows = rows.select(*schema.names)
    if table == "genes":
        rows = rows.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})
    return rows.withColumn("chrom", normalize_chrom(F.col("chrom"))) if "chrom" in rows.columns else rows


def read_gwas_rows(spark: SparkSession, path: str) -> DataFrame:
    """Raw association rows as text cells, with a ``loaded`` mark that is false for malformed ones.

    The catalogue's header repeats no names but is addressed by place, so the rows are split as text. A tab inside a quoted cell
    belongs to the cell; a quote that is never closed is an ordinary character.
    """
    # every cell begins with the tab before it, so that no match is empty
    cells = F.regexp_extract_all(F.concat(F.lit("\t"), F.col("value")), F.lit(QUOTED_CELL), 1)
    rows = spark.read.text(path).filter(~F.col("value").startswith("DATE ADDED TO CATALOG\t")).select(cells.alias("cells"))
    trait = F.trim(F.get("cells", F.lit(GWAS_PLACES["trait"])))
    return rows.withColumn("loaded", (F.size("cells") >= GWAS_MIN_COLUMNS) & (F.coalesce(trait, F.lit("")) != ""))


def _unquoted(cell: Column) -> Column:
    """Cell without the quotes around it; doubled quotes inside become one."""
    inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.when(cell.rlike('^".*"$'), inner).otherwise(cell)


def gwas_associations(rows: DataFrame) -> DataFrame:
    """Typed associations of the well-formed rows."""
    cell = {name: _unquoted(F.get("cells", F.lit(place))) for name, place in GWAS_PLACES.items()}
    return rows.filter("loaded").select(
        gwas_rsid(cell["rsid"]).alias("rsid"),
        normalize_chrom(gwas_chrom(cell["chrom"])).alias("chrom"),
        to_long(cell["pos"]).alias("pos"),
        blank_to_null(cell["mapped_gene"]).alias("mapped_gene"),
        F.trim(cell["trait"]).alias("trait"),
        blank_to_null(cell["mapped_trait"]).alias("mapped_trait"),
        risk_allele(cell["risk_allele"]).alias("risk_allele"),
        to_double(cell["risk_allele_freq"]).alias("risk_allele_freq"),
        to_double(cell["p_value"]).alias("p_value"),
        to_double(cell["or_beta"]).alias("or_beta"),
        blank_to_null(cell["ci_text"]).alias("ci_text"),
        blank_to_null(cell["pubmed_id"]).alias("pubmed_id"),
        blank_to_null(cell["first_author"]).alias("first_author"),
        F.trim(cell["study_accession"]).alias("study_accession"),
    )


# The columns of published scoring files that are read.
SCORING_COLUMNS = ("chr_name", "chr_position", "rsID", "effect_allele", "other_allele", "effect_weight", "hm_rsID", "hm_chr", "hm_pos")


def read_scoring_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw rows of scoring files (all text), with the file each came from.

    Columns are found by name, in any order; columns that a file lacks are NULL and others are ignored. The header line
    of every file is read first, and files with the same header are one scan.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    heads = lines.filter(~F.col("value").startswith("#") & F.col("value").contains("effect_weight")).groupBy("file").agg(F.min("value").alias("head"))
    alike = heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head").collect()  # one name per file
    found = []
    for head, files in alike:
        names = head.split("\t")
        schema = StructType([StructField(name, StringType()) for name in names])
        rows = spark.read.csv(files, sep="\t", comment="#", header=True, schema=schema, enforceSchema=False)
        kept = [F.col(name) if name in names else F.lit(None).cast("string").alias(name) for name in SCORING_COLUMNS]
        found.append(rows.select(*kept, F.col("_metadata.file_path").alias("file")))
    if not found:
        raise ValueError("no scoring file with a header line")
    return reduce(DataFrame.unionByName, found)


def _score_file_stem() -> Column:
    return F.substring_index(F.substring_index("file", "/", -1), "_hmPOS_", 1)


def unlisted_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """(file_stem, weights): scoring files that ``scores(file_stem, ...)`` doesn't list, which ``score_weights`` leaves out, with their rows."""
    found = rows.groupBy(_score_file_stem().alias("file_stem")).agg(F.count("*").alias("weights"))
    return found.join(scores.select("file_stem").distinct(), "file_stem", "left_anti")


def score_weights(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Weights of the scores in ``scores(file_stem, prs_id, trait)``.

    Harmonised columns win over the original ones; rows that are incomplete, off the standard
    chromosomes or not numeric are dropped. ``unlisted_scores`` tells which files are left out as a whole.
    """

    def either(harmonised: str, original: str):
        return F.coalesce(blank_to_null(F.col(harmonised)), blank_to_null(F.col(original)))

    picked = rows.select(
        _score_file_stem().alias("file_stem"),
        either("hm_rsID", "rsID").alias("rsid"),
        either("hm_chr", "chr_name").alias("chrom"),
        to_long(either("hm_pos", "chr_position")).alias("pos"),
        F.coalesce("effect_allele", F.lit("")).alias("effect_allele"),
        to_double(F.col("effect_weight")).alias("weight"),
    ).filter(is_score_chrom(F.col("chrom")) & F.col("rsid").isNotNull() & F.col("pos").isNotNull() & F.col("weight").isNotNull())
    return picked.join(scores, "file_stem").select("prs_id", "trait", "rsid", "chrom", "pos", "effect_allele", "weight")


def read_variant_summary(spark: SparkSession, path: str) -> DataFrame:
    """The clinical archive's per-variant summary; only four of its columns matter."""
    return spark.read.csv(path, sep="\t", header=True).select("Assembly", "ClinicalSignificance", "ReviewStatus", "GeneSymbol")


def pathogenic_genes(summary: DataFrame) -> DataFrame:
    """Genes with a stand-alone ``Pathogenic`` term on GRCh38 and an assertion behind it."""
    symbol = F.trim("GeneSymbol")
    # the cheap substring test runs first, the exact term test only on what it lets through
    wanted = (
        (F.col("Assembly") == "GRCh38")
        & F.lower("ClinicalSignificance").contains("pathogenic")
        & (F.coalesce("ReviewStatus", F.lit("")) != "no assertion criteria provided")
        & (symbol != "")
        & (symbol != "-")
        & F.array_contains(significance_terms(F.col("ClinicalSignificance")), "pathogenic")
    )
    return summary.filter(wanted).select(symbol.alias("symbol")).distinct()


def read_phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """Gene-to-phenotype annotations."""
    return spark.read.csv(path, sep="\t", comment="#", header=True).select("hpo_id", "gene_symbol")


def severe_phenotype_genes(phenotypes: DataFrame, terms: Sequence[str] = SEVERE_PHENOTYPES) -> DataFrame:
    """Genes annotated with any of the terms."""
    symbol = F.trim("gene_symbol")
    return phenotypes.filter(F.trim("hpo_id").isin(*terms) & (symbol != "")).select(symbol.alias("symbol")).distinct()


def read_gene_names(spark: SparkSession, path: str) -> DataFrame:
    """Approved symbols of the gene nomenclature list."""
    rows = spark.read.csv(path, sep="\t", header=True)
    symbol = F.trim("symbol")
    return rows.filter((F.col("status") == "Approved") & (symbol != "")).select(symbol.alias("symbol"))


COORDINATE_RECORD = "symbol string, display_name string, seq_region_name string, `start` bigint, `end` bigint, strand int, description string"


def read_gene_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate records, one JSON object per line, each with the symbol it answers for."""
    return spark.read.schema(COORDINATE_RECORD).json(path)


# The fields used of each drug-gene table.
DRUG_GENE_TABLES = {
    "pair": "drugname string, cpiclevel string, pgxtesting string, guidelineurl string, genesymbol string",
    "gene": "symbol string, chr string",
    "allele": "genesymbol string, name string, clinicalfunctionalstatus string",
    "allele_definition": "id bigint, genesymbol string, name string",
    "sequence_location": "id bigint, genesymbol string, dbsnpid string, chromosomelocation string, position bigint",
    "allele_location_value": "alleledefinitionid bigint, locationid bigint, variantallele string",
}


def read_drug_gene_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The drug-gene source tables (JSON lines, one folder each); pairs of evidence level A or B only."""
    tables = {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in DRUG_GENE_TABLES.items()}
    tables["pair"] = tables["pair"].filter(F.col("cpiclevel").isin("A", "B"))
    return tables


def read_sites(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A site table written by ``sinks.write_sites``; chromosome folders are read as text."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(path)
    return rows.withColumn("chrom", F.col("chrom").cast("string")).select(
        *[name for name in SITE_KEY if name in rows.columns], *[name for name in rows.columns if name not in SITE_KEY]
    )


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """The span summary that ``sinks.write_spans`` stored beside a site table."""
    return spark.read.parquet(f"{path}/_spans")
