"""Building the lookup tables: genes, warning genes, drugs and star alleles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelespan.fixed_values import ACTIONABLE_GENES, PUBLISHED_SCORES
from allelespan.functions.associations import clean_description, drug_summary, hgvs_alleles
from allelespan.functions.contigs import is_catalog_chrom, normalize_chrom
from allelespan.operators.joins import gene_coordinates
from allelespan.operators.ranking import one_star_allele
from allelespan.operators.sizing import top_per_group
from allelespan.session import local_table


def union_gene_lists(first: DataFrame, second: DataFrame) -> DataFrame:
    """Symbols of both lists, each once, with the list it was first seen in."""
    both = first.select("symbol", F.lit(1).alias("list")).unionByName(second.select("symbol", F.lit(2).alias("list")))
    return both.groupBy("symbol").agg(F.min("list").alias("list"))


def gene_catalog(symbols: DataFrame, records: DataFrame) -> DataFrame:
    """Genes with coordinates on standard chromosomes; the display name of the record wins over the asked symbol."""
    found = gene_coordinates(symbols, records).filter(
        F.col("seq_region_name").isNotNull() & is_catalog_chrom(F.col("seq_region_name"))
    )
    return found.select(
        F.coalesce("display_name", "symbol").alias("symbol"),
        clean_description(F.col("description")).alias("name"),
        normalize_chrom(F.col("seq_region_name")).alias("chrom"),
        F.col("start").alias("start_pos"),
        F.col("end").alias("end_pos"),
        F.when(F.coalesce("strand", F.lit(1)) == 1, "+").otherwise("-").alias("strand"),
    )


def symbols_without_coordinates(symbols: DataFrame, records: DataFrame) -> DataFrame:
    """Symbols that have no coordinate record."""
    return symbols.join(records.filter(F.col("seq_region_name").isNotNull()), "symbol", "left_anti")


def actionable_genes(spark: SparkSession) -> DataFrame:
    """Genes whose findings can be acted on."""
    return local_table(spark, [(symbol,) for symbol in ACTIONABLE_GENES], "symbol string")


def published_scores(spark: SparkSession) -> DataFrame:
    """Scores with their traits, keyed by the stem of their file's name."""
    return local_table(spark, [(name, name, trait) for name, trait in PUBLISHED_SCORES], "file_stem string, prs_id string, trait string")


def warning_gene_list(pathogenic: DataFrame, severe: DataFrame, actionable: DataFrame | None = None) -> DataFrame:
    """Genes that are pathogenic and severe but not actionable, sorted."""
    spared = actionable_genes(pathogenic.sparkSession) if actionable is None else actionable
    both = pathogenic.select("symbol").intersect(severe.select("symbol"))
    return both.join(spared.select("symbol"), "symbol", "left_anti").orderBy("symbol")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, columns matched by name."""
    return reduce(DataFrame.unionByName, parts)


def drug_table(pairs: DataFrame) -> DataFrame:
    """Drug-gene pairs with a summary sentence; pairs without drug or gene are dropped."""
    drug, gene = F.lower(F.trim("drugname")), F.trim("genesymbol")
    blank = F.lit("")
    return pairs.filter((F.coalesce(drug, blank) != "") & (F.coalesce(gene, blank) != "")).select(
        drug.alias("drug_name"),
        gene.alias("gene"),
        F.lit("CPIC").alias("guideline_source"),
        F.nullif("guidelineurl", blank).alias("guideline_url"),
        drug_summary(F.col("cpiclevel"), F.col("pgxtesting")).alias("clinical_summary"),
        F.col("cpiclevel").alias("cpic_level"),
        F.nullif("pgxtesting", blank).alias("pgx_testing"),
    )


def star_alleles_by_rsid(tables: dict[str, DataFrame]) -> DataFrame:
    """Star alleles and their functions per gene and identifier, each once, with the number of locations behind it.

    Kept as rows, not as a list per identifier, so no identifier can outgrow a task.
    """
    definitions = tables["allele_definition"].filter(F.coalesce("name", F.lit("")) != "").select(
        F.col("id").alias("alleledefinitionid"), "genesymbol", F.col("name").alias("star_allele")
    )
    functions = top_per_group(
        tables["allele"].select(
            "genesymbol", F.col("name").alias("star_allele"), F.nullif("clinicalfunctionalstatus", F.lit("")).alias("function_impact")
        ),
        ["genesymbol", "star_allele"],
        [F.col("function_impact").asc_nulls_last()],
        1,
    )
    named = tables["allele_location_value"].select("alleledefinitionid", "locationid").join(definitions, "alleledefinitionid")
    located = named.join(parsed_locations(tables["sequence_location"]).select("locationid", "genesymbol", "rsid"), ["locationid", "genesymbol"])
    grouped = located.groupBy("genesymbol", "rsid", "star_allele").agg(F.count_distinct("locationid").alias("locations"))
    return grouped.join(functions, ["genesymbol", "star_allele"], "left").select(
        F.col("genesymbol").alias("gene"), "rsid", "star_allele", "function_impact", "locations"
    )


def parsed_locations(locations: DataFrame) -> DataFrame:
    """Locations with an identifier, a position and readable alleles."""
    alleles = hgvs_alleles(F.col("chromosomelocation"))
    complete = locations.filter((F.coalesce("dbsnpid", F.lit("")) != "") & (F.coalesce("position", F.lit(0)) != 0))
    return complete.withColumn("_alleles", alleles).filter(F.col("_alleles").isNotNull()).select(
        F.col("id").alias("locationid"), "genesymbol", F.col("dbsnpid").alias("rsid"), F.col("position").alias("pos"), "_alleles.ref", "_alleles.alt"
    )


def star_allele_table(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per gene, identifier and star allele for the genes of the drug pairs.

    Locations meet star alleles by identifier within the gene; a location without any keeps a row with
    NULL. Genes without a chromosome are dropped.
    """
    wanted = tables["pair"].filter(F.coalesce("genesymbol", F.lit("")) != "").select("genesymbol").distinct()
    chromosomes = tables["gene"].filter(F.coalesce("chr", F.lit("")) != "").select(
        F.col("symbol").alias("genesymbol"), normalize_chrom(F.col("chr")).alias("chrom")
    )
    places = parsed_locations(tables["sequence_location"]).join(wanted, "genesymbol", "left_semi").join(chromosomes, "genesymbol")
    stars = star_alleles_by_rsid(tables).drop("locations")
    rows = places.withColumnRenamed("genesymbol", "gene").join(stars, ["gene", "rsid"], "left")
    return one_star_allele(rows.select("gene", "rsid", "chrom", "pos", "ref", "alt", "star_allele", "function_impact"))
