"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.functions.contigs import accession_table
from allelespan.operators import filters, packed, reference_builds
from allelespan.operators.intervals import within_intervals
from allelespan.sources import sinks, tables, vcf
from testbed import texts
from testbed.registry import Tables, query

_KEY = "chrom, pos, ref, alt"


def read_back(t: Tables, lines: DataFrame) -> DataFrame:
    return vcf.read_vcf_lines(t.spark, t.write_lines(lines))


@query("scan_vcf_text", f"SELECT {_KEY}, vcf_id AS rsid, clnsig, clndn, af FROM d_sites")
def scan_vcf_text(t: Tables) -> DataFrame:
    info = "concat_ws(';', 'CLNSIGX=no', 'CLNDN=' || clndn, 'CLNSIG=' || clnsig, 'AF_grpmax=0.5', 'AF=' || cast(af AS string))"
    parsed = vcf.parse_vcf(read_back(t, texts.site_lines(t, info)), ["CLNSIG", "CLNDN", "AF"])
    return parsed.select("chrom", "pos", "ref", "alt", "rsid", F.col("CLNSIG").alias("clnsig"), F.col("CLNDN").alias("clndn"), F.col("AF").cast("double").alias("af"))


@query("scan_region", "SELECT genome, chrom, pos, ref, alt, gt FROM d_calls WHERE chrom = '3' AND pos BETWEEN 2000 AND 500000")
def scan_region(t: Tables) -> DataFrame:
    path = t.folder()
    sinks.write_sites(t.calls, path)
    calls = tables.read_sites(t.spark, path)
    return filters.in_region(calls, "chr3", 2000, 500000).select("genome", "chrom", "pos", "ref", "alt", "gt")


@query(
    "scan_region_overlap",
    "SELECT genome, chrom, pos, ref, alt FROM d_calls WHERE chrom = '10' AND pos <= 400000 AND pos + length(ref) - 1 >= 1336",
)
def scan_region_overlap(t: Tables) -> DataFrame:
    path = t.folder()
    sinks.write_sites(t.calls, path)
    sinks.write_spans(t.spark, path)
    calls, spans = tables.read_sites(t.spark, path), tables.read_spans(t.spark, path)
    return filters.overlapping_region(calls, "chr10", 1336, 400000, spans).select("genome", "chrom", "pos", "ref", "alt")


@query(
    "scan_regions_any_length",
    """SELECT r.k AS region, c.genome, c.chrom, c.pos, c.ref, c.alt FROM d_calls c
       JOIN (SELECT l_orderkey * 10 + l_linenumber AS k, cast(1 + l_orderkey % 22 AS varchar) AS chrom, 1 + l_partkey * 37 AS a,
                    1 + l_partkey * 37 + cast(power(10, 1 + l_linenumber) AS bigint) AS b FROM lineitem WHERE l_quantity > 49) r
       ON c.chrom = r.chrom AND c.pos BETWEEN r.a AND r.b""",
)
def scan_regions_any_length(t: Tables) -> DataFrame:
    """Intervals from a hundred bases to a hundred million, one row each on the interval side."""
    spans = t.sql(
        """SELECT l_orderkey * 10 + l_linenumber AS region, cast(1 + l_orderkey % 22 AS string) AS chrom, cast(1 + l_partkey * 37 AS bigint) AS start_pos,
                  cast(1 + l_partkey * 37 + power(10, 1 + l_linenumber) AS bigint) AS end_pos FROM lineitem WHERE l_quantity > 49"""
    )
    return within_intervals(t.calls, spans).select("region", "genome", "chrom", "pos", "ref", "alt")


_REGIONS = ["chr1:1-40000", "chrX:1000-60000", "chrMT:1-900000", "chr1:30000-80000"]


@query(
    "scan_regions",
    """SELECT r.region, c.genome, c.chrom, c.pos, c.ref, c.alt FROM d_calls c
       JOIN (VALUES ('chr1:1-40000', '1', 1, 40000), ('chrX:1000-60000', 'X', 1000, 60000), ('chrMT:1-900000', 'MT', 1, 900000),
                    ('chr1:30000-80000', '1', 30000, 80000)) r(region, chrom, a, b)
       ON c.chrom = r.chrom AND c.pos BETWEEN r.a AND r.b""",
)
def scan_regions(t: Tables) -> DataFrame:
    return filters.in_regions(t.calls, _REGIONS, labelled=True).select("region", "genome", "chrom", "pos", "ref", "alt")


_SAMPLES = " UNION ALL ".join(
    f"SELECT 'S{i}' AS genome, {_KEY}, id, coalesce(min(gt) FILTER (WHERE s % 3 = {i}), './.') AS gt FROM d_calls GROUP BY {_KEY}, id" for i in range(3)
)


@query("scan_samples", _SAMPLES)
def scan_samples(t: Tables) -> DataFrame:
    return vcf.parse_calls(vcf.read_vcf_lines(t.spark, texts.sample_files(t)))


@query("scan_samples_packed", _SAMPLES)
def scan_samples_packed(t: Tables) -> DataFrame:
    """Stored packed, one row per site, and unpacked again."""
    lines, path = vcf.read_vcf_lines(t.spark, texts.sample_files(t)), t.folder()
    sinks.write_sites(vcf.parse_packed(lines), path)
    return packed.unpack_calls(tables.read_sites(t.spark, path), vcf.sample_names(lines))


@query("scan_one_sample", f"SELECT * FROM ({_SAMPLES}) samples WHERE genome = 'S1'")
def scan_one_sample(t: Tables) -> DataFrame:
    return vcf.parse_one_sample(vcf.read_vcf_lines(t.spark, texts.sample_files(t)), "S1")


@query("scan_position", "SELECT genome, chrom, pos, ref, alt, gt FROM d_calls WHERE chrom = '4' AND pos BETWEEN 1110 AND 1111")
def scan_position(t: Tables) -> DataFrame:
    return filters.at_position(t.calls, "chr4:1110").select("genome", "chrom", "pos", "ref", "alt", "gt")


@query(
    "scan_snpeff_layer",
    f"""SELECT {_KEY}, vcf_id AS rsid, CASE WHEN vcf_id IS NOT NULL THEN 'vcf' END AS rsid_source,
               gene, effect, impact, transcript, hgvs_c, hgvs_p FROM d_sites""",
)
def scan_snpeff_layer(t: Tables) -> DataFrame:
    return vcf.effect_layer(read_back(t, texts.site_lines(t, texts.EFFECT_INFO)))


@query("scan_clinvar_layer", f"SELECT {_KEY}, clnsig, clndn, clnrevstat FROM d_sites WHERE clnsig IS NOT NULL")
def scan_clinvar_layer(t: Tables) -> DataFrame:
    return vcf.clinical_layer(read_back(t, texts.site_lines(t, texts.CLINICAL_INFO, "cast(k AS string)", "chrom")))


@query("scan_gnomad_layer", f"SELECT {_KEY}, af, af_grpmax FROM d_sites WHERE af IS NOT NULL OR af_grpmax IS NOT NULL")
def scan_gnomad_layer(t: Tables) -> DataFrame:
    return vcf.frequency_layer(read_back(t, texts.site_lines(t, texts.FREQUENCY_INFO)))


@query("scan_dbsnp_layer", f"SELECT {_KEY}, dbsnp_id AS rsid FROM d_sites WHERE dbsnp_id IS NOT NULL")
def scan_dbsnp_layer(t: Tables) -> DataFrame:
    return vcf.identifier_layer(read_back(t, texts.identifier_lines(t)), accession_table(t.spark))


_GWAS_COLUMNS = """rsid, chrom, pos, mapped_gene, trait, mapped_trait, risk_allele, risk_allele_freq, p_value, or_beta, ci_text,
                   pubmed_id, first_author, study_accession"""


@query("scan_gwas_tsv", f"SELECT {_GWAS_COLUMNS} FROM d_gwas")
def scan_gwas_tsv(t: Tables) -> DataFrame:
    return tables.gwas_associations(tables.read_gwas_rows(t.spark, t.write_lines(texts.gwas_lines(t))))


@query("scan_seed_tsv", "SELECT symbol, CASE WHEN start_pos % 3 <> 0 THEN name END AS name, chrom, start_pos, end_pos, strand FROM d_genes")
def scan_seed_tsv(t: Tables) -> DataFrame:
    name = "CASE WHEN start_pos % 3 <> 0 THEN name WHEN start_pos % 2 = 0 THEN '.' ELSE '' END"
    row = f"concat_ws('\t', symbol, {name}, 'chr' || chrom, cast(start_pos AS string), cast(end_pos AS string), strand)"
    lines = t.sql(f"SELECT {row} AS value, chrom AS file_key FROM d_genes")
    path = texts.write_files(t, lines, ["# generated", "symbol\tname\tchrom\tstart\tend\tstrand"])
    return tables.read_seed(t.spark, path, "genes")


@query(
    "scan_pgs_scores",
    "SELECT prs_id, trait, rsid, chrom, pos, effect_allele, weight FROM d_prs WHERE rsid NOT LIKE '%7'",
)
def scan_pgs_scores(t: Tables) -> DataFrame:
    scores = t.prs.select("prs_id", "trait").distinct()
    return tables.score_weights(_scoring_rows(t), scores.withColumn("file_stem", F.col("prs_id")))


@query("scan_pgs_unlisted", "SELECT prs_id AS file_stem, count(*) AS weights FROM d_prs WHERE trait <> 'Shared trait' GROUP BY prs_id")
def scan_pgs_unlisted(t: Tables) -> DataFrame:
    """Files of scores that are not on the list; unusable rows count too."""
    listed = t.prs.filter("trait = 'Shared trait'").select(F.col("prs_id").alias("file_stem")).distinct()
    return tables.unlisted_scores(_scoring_rows(t), listed)


def _scoring_rows(t: Tables) -> DataFrame:
    # identifiers ending in 7 get an unusable row: no weight, a scaffold, or a position that is no number
    bad = "rsid LIKE '%7'"
    columns = {
        "chr_name": f"CASE WHEN {bad} AND rsid LIKE '%17' THEN 'GL000' ELSE chrom END",
        "chr_position": f"CASE WHEN {bad} AND rsid LIKE '%27' THEN 'n/a' ELSE cast(pos AS string) END",
        "rsID": "rsid", "effect_allele": "effect_allele", "other_allele": "'N'",
        "effect_weight": f"CASE WHEN {bad} AND rsid NOT LIKE '%17' AND rsid NOT LIKE '%27' THEN '' ELSE cast(weight AS string) END",
        "hm_rsID": "CASE WHEN pos % 2 = 0 THEN rsid ELSE '' END",
        "hm_chr": f"CASE WHEN pos % 2 = 0 AND NOT ({bad}) THEN chrom ELSE '' END",
        "hm_pos": f"CASE WHEN pos % 2 = 0 AND NOT ({bad}) THEN cast(pos AS string) ELSE '' END",
    }
    named = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
    folder = t.folder()
    keyed = t.sql(f"SELECT {named}, prs_id FROM d_prs")
    keyed.write.partitionBy("prs_id").csv(folder, sep="\t", header=True)
    raw = tables.read_scoring_files(t.spark, [folder])
    # published names are <score>_hmPOS_<build>.txt.gz; the writer's folders carry the score here
    return raw.withColumn("file", F.concat(F.regexp_extract("file", "prs_id=([^/]+)/", 1), F.lit("_hmPOS_GRCh38.txt")))


_SUMMARY = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'GRCh38' ELSE 'GRCh37' END AS Assembly,
       CASE o_orderkey % 12 WHEN 0 THEN 'Likely pathogenic' WHEN 2 THEN 'Benign' WHEN 4 THEN 'Pathogenic/Likely pathogenic' WHEN 6 THEN 'Pathogenic'
            WHEN 8 THEN 'Conflicting classifications of pathogenicity' ELSE 'not provided, Pathogenic' END AS ClinicalSignificance,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'no assertion criteria provided' ELSE 'criteria provided' END AS ReviewStatus,
       CASE WHEN o_custkey % 50 = 0 THEN '-' ELSE 'BRAND' || cast(1 + o_custkey % 60 AS string) END AS GeneSymbol, o_orderkey AS k FROM orders"""


def variant_summary(t: Tables) -> DataFrame:
    path = t.folder()
    t.sql(_SUMMARY).write.csv(path, sep="\t", header=True, compression="gzip")
    return tables.read_variant_summary(t.spark, path)


O_PATHOGENIC = f"""SELECT DISTINCT GeneSymbol AS symbol FROM ({_SUMMARY}) summary WHERE Assembly = 'GRCh38' AND k % 12 IN (4, 6, 10)
                   AND ReviewStatus <> 'no assertion criteria provided' AND GeneSymbol <> '-'"""


@query("scan_clinvar_summary", O_PATHOGENIC)
def scan_clinvar_summary(t: Tables) -> DataFrame:
    return tables.pathogenic_genes(variant_summary(t))


_PHENOTYPES = """SELECT CASE c_custkey % 7 WHEN 0 THEN 'HP:0001522' WHEN 1 THEN 'HP:0002180' WHEN 2 THEN 'HP:0000001' ELSE 'HP:0000' || cast(c_custkey % 7 AS string) END AS hpo_id,
       'BRAND' || cast(1 + c_custkey % 40 AS string) AS gene_symbol, c_acctbal FROM customer"""


def phenotypes(t: Tables) -> DataFrame:
    path = t.folder()
    t.sql(_PHENOTYPES).select("hpo_id", "gene_symbol").write.csv(path, sep="\t", header=True)
    return tables.read_phenotypes(t.spark, path)


O_SEVERE = f"SELECT DISTINCT gene_symbol AS symbol FROM ({_PHENOTYPES}) p WHERE hpo_id IN ('HP:0001522', 'HP:0002180')"


@query("scan_hpo", O_SEVERE)
def scan_hpo(t: Tables) -> DataFrame:
    return tables.severe_phenotype_genes(phenotypes(t))


def gene_names(t: Tables) -> DataFrame:
    path = t.folder()
    t.sql("SELECT ' ' || s_name AS symbol, CASE WHEN s_nationkey % 5 = 0 THEN 'Entry Withdrawn' ELSE 'Approved' END AS status, s_suppkey AS hgnc_id FROM supplier").write.csv(
        path, sep="\t", header=True
    )
    return tables.read_gene_names(t.spark, path)


def gene_records(t: Tables) -> DataFrame:
    """Coordinate records; nation 3's are missing, nation 4's lie on scaffolds, customers' fit no symbol."""
    path = t.folder()
    t.sql(
        """SELECT s_name AS symbol, CASE WHEN s_nationkey % 2 = 0 THEN 'display ' || s_name END AS display_name,
                  CASE WHEN s_nationkey = 4 THEN 'KI270721.1' WHEN s_nationkey = 6 THEN 'MT' ELSE cast(1 + s_nationkey % 22 AS string) END AS seq_region_name,
                  1000 + s_suppkey AS `start`, 2000 + s_suppkey AS `end`, CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE -1 END AS strand,
                  CASE WHEN s_nationkey % 7 <> 0 THEN 'about ' || s_name || ' [Source:HGNC Symbol;Acc:HGNC:' || cast(s_suppkey AS string) || ']' END AS description
           FROM supplier WHERE s_nationkey <> 3"""
    ).write.json(path)
    return tables.read_gene_coordinates(t.spark, path)


O_GENE_CATALOG = """SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'display ' || s_name ELSE s_name END AS symbol,
       CASE WHEN s_nationkey % 7 <> 0 THEN 'about ' || s_name ELSE '' END AS name, CASE WHEN s_nationkey = 6 THEN 'MT' ELSE cast(1 + s_nationkey % 22 AS string) END AS chrom,
       1000 + s_suppkey AS start_pos, 2000 + s_suppkey AS end_pos, CASE WHEN s_nationkey % 3 = 0 THEN '+' ELSE '-' END AS strand
       FROM supplier WHERE s_nationkey NOT IN (3, 4) AND s_nationkey % 5 <> 0"""


@query("scan_gene_catalog", O_GENE_CATALOG)
def scan_gene_catalog(t: Tables) -> DataFrame:
    return reference_builds.gene_catalog(gene_names(t), gene_records(t))


CPIC_SOURCES = {
    "pair": """SELECT ' ' || n_name AS drugname, CASE n_nationkey % 4 WHEN 3 THEN 'C' WHEN 2 THEN 'B' ELSE 'A' END AS cpiclevel,
                      CASE n_regionkey WHEN 0 THEN 'Actionable PGx' WHEN 1 THEN '' END AS pgxtesting,
                      CASE WHEN n_nationkey % 2 = 0 THEN 'https://example.org/' || cast(n_nationkey AS string) END AS guidelineurl,
                      CASE WHEN n_nationkey <> 8 THEN 'BRAND' || cast(1 + n_nationkey % 25 AS string) ELSE '' END AS genesymbol FROM nation""",
    "gene": "SELECT DISTINCT brand AS symbol, CASE WHEN brand <> 'BRAND5' THEN 'chr' || replace(brand, 'BRAND', '') END AS chr FROM d_sites",
    "allele": """SELECT DISTINCT brand AS genesymbol, '*' || cast(k % 7 AS string) AS name,
                        CASE k % 7 WHEN 0 THEN 'Normal function' WHEN 1 THEN 'No function' WHEN 2 THEN '' END AS clinicalfunctionalstatus
                 FROM d_sites""",
    # definitions have one name more than the alleles
    "allele_definition": "SELECT DISTINCT cast(replace(brand, 'BRAND', '') AS bigint) * 10 + k % 8 AS id, brand AS genesymbol, '*' || cast(k % 8 AS string) AS name FROM d_sites",
    "sequence_location": """SELECT k + 1 AS id, brand AS genesymbol, dbsnp_id AS dbsnpid,
                                   CASE k % 4 WHEN 0 THEN 'g.' || cast(pos AS string) || 'A>G' WHEN 1 THEN 'g.' || cast(pos AS string) || 'del'
                                        WHEN 2 THEN 'g.' || cast(pos AS string) || 'delAC' ELSE 'g.' || cast(pos AS string) || '_5ins' END AS chromosomelocation,
                                   pos AS position FROM d_sites""",
    "allele_location_value": """SELECT cast(replace(brand, 'BRAND', '') AS bigint) * 10 + k % 7 AS alleledefinitionid, k + 1 AS locationid, alt AS variantallele
                                FROM d_sites
                                UNION ALL
                                SELECT cast(replace(brand, 'BRAND', '') AS bigint) * 10 + (k + 2) % 8, k + 1, alt FROM d_sites""",
}


def cpic(t: Tables) -> dict[str, DataFrame]:
    folder = t.folder()
    for name, select in CPIC_SOURCES.items():
        t.sql(select).write.json(f"{folder}/{name}")
    return tables.read_drug_gene_tables(t.spark, folder)


@query(
    "scan_cpic",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows FROM ({select}) s" + (" WHERE cpiclevel IN ('A', 'B')" if name == "pair" else "")
        for name, select in CPIC_SOURCES.items()
    ),
)
def scan_cpic(t: Tables) -> DataFrame:
    return reference_builds.union_all([df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, df in cpic(t).items()])


@query("sink_layer", f"SELECT {_KEY}, clnsig, clndn, clnrevstat FROM d_sites WHERE clnsig IS NOT NULL")
def sink_layer(t: Tables) -> DataFrame:
    store = sinks.LayerStore(t.spark, t.folder())
    layer = t.sites.filter("clnsig IS NOT NULL").select("chrom", "pos", "ref", "alt", "clnsig", "clndn", "clnrevstat")
    store.write("clinvar", layer.withColumn("clnsig", F.lit("superseded")))
    store.write("clinvar", layer)
    return store.read("clinvar")


@query("sink_tsv", "SELECT gene, rsid, chrom, pos, ref, alt, star_allele, function_impact, notes FROM d_pgx_variants")
def sink_tsv(t: Tables) -> DataFrame:
    path = t.folder()
    sinks.write_tsv(t.pgx_variants, path, ["gene", "rsid", "star_allele"])
    return tables.read_seed(t.spark, path, "pgx_variants")
