"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.operators import joins, layers, reference_builds
from allelespan.plans.traits import sensitive_associations
from allelespan.schemas import CLINICAL_COLUMNS
from allelespan.sources import sinks
from testbed.cases_sources import O_GENE_CATALOG, CPIC_SOURCES, cpic, gene_names, gene_records
from testbed.registry import Tables, query

_KEY = "chrom, pos, ref, alt"
_CALL = "genome, " + _KEY
_CALL_KEY = ["genome", "chrom", "pos", "ref", "alt"]
_NOTES = ["rsid", "rsid_source", "gene", "effect", "impact", "transcript", "hgvs_c", "hgvs_p", "clnsig", "clndn", "clnrevstat", "af", "af_grpmax"]
_ANNOTATED = f"SELECT {_CALL}, gt, {', '.join(_NOTES)} FROM o_annotated"


@query("join_annotate", _ANNOTATED)
def join_annotate(t: Tables) -> DataFrame:
    return joins.annotate(t.calls, t.annotations)


@query("join_annotate_salted", _ANNOTATED)
def join_annotate_salted(t: Tables) -> DataFrame:
    return joins.annotate(t.calls, t.annotations, salted=True)


@query("join_annotate_bucketed", _ANNOTATED)
def join_annotate_bucketed(t: Tables) -> DataFrame:
    """Both tables written in buckets once; the join then reads them without a shuffle."""
    folder = t.folder()
    name = "annotate_" + folder.rsplit("-", 1)[1]
    sinks.write_bucketed(t.calls, f"{name}_calls", f"{folder}/calls", 16)
    sinks.write_bucketed(t.annotations, f"{name}_annotations", f"{folder}/annotations", 16)
    return joins.annotate(t.spark.table(f"{name}_calls"), t.spark.table(f"{name}_annotations"))


@query("join_rsid", f"SELECT {_CALL}, gt, rsid, gene, impact FROM o_annotated WHERE rsid = 'rs50' AND (chrom, pos, ref, alt) IN (SELECT {_KEY} FROM d_annotations)")
def join_rsid(t: Tables) -> DataFrame:
    return joins.calls_for_rsids(t.calls, t.annotations, ["rs50"]).select(*_CALL_KEY, "gt", "rsid", "gene", "impact")


_REQUEST = ["rs50", "rs7", "rs999999999", "rs13", "rs88888888", "rs21"]
_REQUEST_SQL = ", ".join(f"({i}, '{rsid}')" for i, rsid in enumerate(_REQUEST, 1))


@query(
    "join_rsid_batch",
    f"""SELECT r.request_order, r.rsid, c.genome, a.chrom, a.pos, a.ref, a.alt, c.gt, CASE WHEN c.genome IS NOT NULL THEN a.gene END AS gene, c.genome IS NOT NULL AS found
        FROM (SELECT cast(o AS bigint) AS request_order, rsid FROM (VALUES {_REQUEST_SQL}) v(o, rsid)) r
        LEFT JOIN (d_annotations a JOIN d_calls c ON a.chrom = c.chrom AND a.pos = c.pos AND a.ref = c.ref AND a.alt = c.alt) ON a.rsid = r.rsid""",
)
def join_rsid_batch(t: Tables) -> DataFrame:
    rows = joins.rsid_batch(t.calls, t.annotations, _REQUEST)
    return rows.select("request_order", "rsid", *_CALL_KEY, "gt", "gene", "found")


@query(
    "join_missing_rsids",
    f"""SELECT cast(o AS bigint) AS request_order, rsid FROM (VALUES {_REQUEST_SQL}) v(o, rsid) WHERE rsid NOT IN (
        SELECT a.rsid FROM d_annotations a JOIN d_calls c ON a.chrom = c.chrom AND a.pos = c.pos AND a.ref = c.ref AND a.alt = c.alt WHERE a.rsid IS NOT NULL)""",
)
def join_missing_rsids(t: Tables) -> DataFrame:
    return joins.missing_rsids(t.calls, t.annotations, _REQUEST)


@query("join_missing_symbols", "SELECT DISTINCT lower(brand) AS symbol FROM d_sites WHERE brand NOT IN (SELECT symbol FROM d_genes WHERE strand = '+')")
def join_missing_symbols(t: Tables) -> DataFrame:
    symbols = t.sites.select(F.lower("brand").alias("symbol")).distinct()
    return joins.missing_symbols(t.genes.filter("strand = '+'"), symbols)


@query(
    "join_clinvar_genotypes",
    f"""SELECT c.genome, a.chrom, a.pos, a.ref, a.alt, c.gt, a.gene, a.clnsig FROM d_annotations a
        JOIN d_calls c ON a.chrom = c.chrom AND a.pos = c.pos AND a.ref = c.ref AND a.alt = c.alt WHERE contains(lower(a.clnsig), 'pathogenic')""",
)
def join_clinvar_genotypes(t: Tables) -> DataFrame:
    rows = joins.calls_with_significance(t.calls, t.annotations, "Pathogenic")
    return rows.select(*_CALL_KEY, "gt", "gene", "clnsig")


# A newer clinical release, laid out from lineitem: sites that occur there get a new significance.
_RELEASE = """SELECT chrom, pos, ref, alt, CASE WHEN n % 2 = 0 THEN 'Likely_benign' ELSE clnsig END AS clnsig, cast(n AS string) AS clndn, cast(NULL AS string) AS clnrevstat
              FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) r JOIN d_sites ON r.k = d_sites.k"""
_OLD = ", ".join(f"a.{name}" for name in _NOTES if name not in CLINICAL_COLUMNS)


def release(t: Tables) -> DataFrame:
    return t.sql(_RELEASE).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "join_layer_update",
    f"""SELECT a.chrom, a.pos, a.ref, a.alt, {_OLD}, CASE WHEN l.chrom IS NOT NULL THEN l.clnsig ELSE a.clnsig END AS clnsig,
               CASE WHEN l.chrom IS NOT NULL THEN l.clndn ELSE a.clndn END AS clndn, CASE WHEN l.chrom IS NOT NULL THEN l.clnrevstat ELSE a.clnrevstat END AS clnrevstat
        FROM d_annotations a LEFT JOIN ({_RELEASE}) l ON a.chrom = l.chrom AND a.pos = l.pos AND a.ref = l.ref AND a.alt = l.alt""",
)
def join_layer_update(t: Tables) -> DataFrame:
    return layers.update_layer(t.annotations, release(t), CLINICAL_COLUMNS)


# New effect calls: sites of returned items, and new alleles at the same places.
_NEW_EFFECTS = """SELECT chrom, pos, ref, CASE WHEN n % 3 = 0 THEN 'TTT' ELSE alt END AS alt, CASE WHEN n % 2 = 0 THEN 'rs' || cast(900000 + k AS string) END AS rsid,
              CASE WHEN n % 2 = 0 THEN 'vcf' END AS rsid_source, 'NEW' || cast(n AS string) AS gene, 'new_variant' AS effect, CASE WHEN n % 4 <> 0 THEN 'HIGH' END AS impact,
              'T' AS transcript, 'c' AS hgvs_c, cast(NULL AS string) AS hgvs_p
              FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey) r JOIN d_sites USING (k)"""
_EFFECTS = ["gene", "effect", "impact", "transcript", "hgvs_c", "hgvs_p"]
_REST = ", ".join(f"a.{name}" for name in ["clnsig", "clndn", "clnrevstat", "af", "af_grpmax"])


@query(
    "join_upsert",
    f"""SELECT coalesce(a.chrom, e.chrom) AS chrom, coalesce(a.pos, e.pos) AS pos, coalesce(a.ref, e.ref) AS ref, coalesce(a.alt, e.alt) AS alt,
               coalesce(e.rsid, a.rsid) AS rsid, coalesce(e.rsid_source, a.rsid_source) AS rsid_source,
               {', '.join(f'CASE WHEN e.chrom IS NOT NULL THEN e.{n} ELSE a.{n} END AS {n}' for n in _EFFECTS)}, {_REST}
        FROM d_annotations a FULL JOIN ({_NEW_EFFECTS}) e ON a.chrom = e.chrom AND a.pos = e.pos AND a.ref = e.ref AND a.alt = e.alt""",
)
def join_upsert(t: Tables) -> DataFrame:
    fresh = t.sql(_NEW_EFFECTS).withColumn("pos", F.col("pos").cast("bigint"))
    return layers.upsert_effects(t.annotations, fresh)


@query("join_dbsnp_backfill", f"SELECT {_KEY}, coalesce(vcf_id, dbsnp_id) AS rsid, CASE WHEN vcf_id IS NOT NULL THEN 'vcf' WHEN dbsnp_id IS NOT NULL THEN 'dbsnp' END AS rsid_source FROM d_sites")
def join_dbsnp_backfill(t: Tables) -> DataFrame:
    base = t.sites.select("chrom", "pos", "ref", "alt", F.col("vcf_id").alias("rsid"), F.when(F.col("vcf_id").isNotNull(), "vcf").alias("rsid_source"))
    source = t.sites.filter("dbsnp_id IS NOT NULL").select("chrom", "pos", "ref", "alt", F.col("dbsnp_id").alias("rsid"))
    return layers.backfill_rsids(base, source)


@query(
    "join_gene_interval",
    "SELECT g.symbol, c.genome, c.chrom, c.pos, c.ref, c.alt FROM d_calls c JOIN o_padded g ON c.chrom = g.chrom AND c.pos BETWEEN g.start_pos AND g.end_pos",
)
def join_gene_interval(t: Tables) -> DataFrame:
    return joins.within_intervals(t.calls, joins.padded_genes(t.genes)).select("symbol", *_CALL_KEY)


@query(
    "join_gene_region",
    "SELECT g.symbol, g.start_pos, g.end_pos, a.chrom, a.pos, a.rsid FROM d_annotations a JOIN o_padded g ON a.chrom = g.chrom AND a.pos BETWEEN g.start_pos AND g.end_pos WHERE g.symbol = 'BRAND6'",
)
def join_gene_region(t: Tables) -> DataFrame:
    region = joins.gene_region(t.genes, ["brand6"])
    return joins.within_intervals(t.annotations.filter(region.near), region.table).select("symbol", "start_pos", "end_pos", "chrom", "pos", "rsid")


_STATUS = """coalesce(c.display || ' (' || CASE c.zygosity WHEN 'homozygous_ref' THEN 'ref' WHEN 'heterozygous' THEN 'het' WHEN 'homozygous_alt' THEN 'hom alt' ELSE 'no call' END || ')',
             'ref or not covered') AS status"""


@query(
    "join_pgx_genotypes",
    f"""SELECT g.genome, d.drug_name, d.gene, v.rsid, v.star_allele, v.chrom, v.pos, v.function_impact, {_STATUS}
        FROM d_pgx_drugs d JOIN d_pgx_variants v ON d.gene = v.gene CROSS JOIN (VALUES ('g2'), ('g8')) g(genome)
        LEFT JOIN o_first_calls c ON v.chrom = c.chrom AND v.pos = c.pos AND c.genome = g.genome""",
)
def join_pgx_genotypes(t: Tables) -> DataFrame:
    rows = joins.pgx_genotypes(t.pgx_drugs, t.pgx_variants, t.calls, ["g2", "g8"])
    return rows.select("genome", "drug_name", "gene", "rsid", "star_allele", "chrom", "pos", "function_impact", "status")


@query("join_prs", "SELECT genome, prs_id, rsid, chrom, pos, effect_allele, weight, cast(dosage AS bigint) AS dosage, CASE WHEN dosage = 0 THEN 0.0::double ELSE round(dosage * weight, 6) END AS contribution FROM o_scored")
def join_prs(t: Tables) -> DataFrame:
    rows = joins.score_contributions(t.prs, t.calls)
    return rows.select("genome", "prs_id", "rsid", "chrom", "pos", "effect_allele", "weight", "dosage", F.round("contribution", 6).alias("contribution"))


@query(
    "join_gwas_genotypes",
    """SELECT w.k, w.rsid, w.trait, f.genome, f.display, f.zygosity FROM d_gwas w LEFT JOIN (
           SELECT c.genome, a.rsid, c.display, c.zygosity FROM d_annotations a
           JOIN o_calls c ON a.chrom = c.chrom AND a.pos = c.pos AND a.ref = c.ref AND a.alt = c.alt
           QUALIFY row_number() OVER (PARTITION BY c.genome, a.rsid ORDER BY c.chrom, c.pos, c.ref, c.alt, c.gt) = 1) f ON w.rsid = f.rsid
    """,
)
def join_gwas_genotypes(t: Tables) -> DataFrame:
    rows = joins.association_genotypes(t.view("d_gwas"), t.calls, t.annotations)
    return rows.select("k", "rsid", "trait", "genome", "genotype.display", "genotype.zygosity")


@query("join_gene_coords", O_GENE_CATALOG)
def join_gene_coords(t: Tables) -> DataFrame:
    return reference_builds.gene_catalog(gene_names(t), gene_records(t))


@query("join_gene_coords_missing", "SELECT s_name AS symbol FROM supplier WHERE s_nationkey = 3")
def join_gene_coords_missing(t: Tables) -> DataFrame:
    return reference_builds.symbols_without_coordinates(gene_names(t), gene_records(t))


_LOCATIONS = f"""SELECT id, genesymbol, dbsnpid AS rsid, position AS pos, CASE k4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'AC' END AS ref, CASE k4 WHEN 0 THEN 'G' ELSE 'del' END AS alt
                 FROM (SELECT *, (id - 1) % 4 AS k4 FROM ({CPIC_SOURCES['sequence_location']}) l) m WHERE dbsnpid IS NOT NULL AND k4 <> 3"""
O_STARS = f"""SELECT d.genesymbol AS gene, l.rsid, d.name AS star_allele, nullif(f.clinicalfunctionalstatus, '') AS function_impact, count(DISTINCT l.id) AS locations
              FROM ({CPIC_SOURCES['allele_location_value']}) v JOIN ({CPIC_SOURCES['allele_definition']}) d ON v.alleledefinitionid = d.id
              JOIN ({_LOCATIONS}) l ON v.locationid = l.id AND l.genesymbol = d.genesymbol
              LEFT JOIN ({CPIC_SOURCES['allele']}) f ON f.genesymbol = d.genesymbol AND f.name = d.name GROUP BY 1, 2, 3, 4"""


@query(
    "join_cpic_star_alleles",
    f"""SELECT l.genesymbol AS gene, l.rsid, replace(g.chr, 'chr', '') AS chrom, l.pos, l.ref, l.alt, s.star_allele, s.function_impact
        FROM ({_LOCATIONS}) l JOIN ({CPIC_SOURCES['gene']}) g ON l.genesymbol = g.symbol AND g.chr IS NOT NULL
        LEFT JOIN ({O_STARS}) s ON s.gene = l.genesymbol AND s.rsid = l.rsid
        WHERE l.genesymbol IN (SELECT genesymbol FROM ({CPIC_SOURCES['pair']}) p WHERE cpiclevel IN ('A', 'B'))
        QUALIFY row_number() OVER (PARTITION BY l.genesymbol, l.rsid, s.star_allele ORDER BY l.pos, l.ref, l.alt) = 1""",
)
def join_cpic_star_alleles(t: Tables) -> DataFrame:
    return reference_builds.star_allele_table(cpic(t))


@query("join_warning_genes", "SELECT DISTINCT genome, gene FROM o_annotated WHERE gene IN (SELECT symbol FROM d_warning_genes)")
def join_warning_genes(t: Tables) -> DataFrame:
    genes = joins.annotate(t.calls, t.annotations).select("genome", F.col("gene").alias("symbol")).distinct()
    return joins.in_warning_genes(genes, t.warning_genes).withColumnRenamed("symbol", "gene")


@query(
    "join_warning_gwas",
    "SELECT DISTINCT symbol FROM (SELECT trim(unnest(string_split(mapped_gene, ' - '))) AS symbol FROM d_gwas) s WHERE symbol IN (SELECT symbol FROM d_warning_genes)",
)
def join_warning_gwas(t: Tables) -> DataFrame:
    return sensitive_associations(t.gwas, t.warning_genes)


@query(
    "join_genome_pair",
    f"""SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, coalesce(a.ref, b.ref) AS ref, coalesce(a.alt, b.alt) AS alt, coalesce(a.id, b.id) AS id,
               a.display AS display_1, a.zygosity AS zygosity_1, b.display AS display_2, b.zygosity AS zygosity_2
        FROM (SELECT * FROM o_calls WHERE genome = 'g1') a FULL JOIN (SELECT * FROM o_calls WHERE genome = 'g4') b
        ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt""",
)
def join_genome_pair(t: Tables) -> DataFrame:
    return joins.pair_genomes(t.calls, "g1", "g4")
