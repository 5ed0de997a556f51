"""The query functions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.plans import overview, traits, variants
from allelespan.plans.cohort import ALL_GENOMES
from allelespan.sources import sinks
from testbed.cases_joins import _STATUS
from testbed.registry import GENOME_RANK, Tables, query

_KEY = "chrom, pos, ref, alt"
_CALL = "genome, " + _KEY
_ORDER = f"{GENOME_RANK.format('chrom')}, pos, ref, alt"
_SIG = "replace(clnsig, '_', ' ') AS significance"
_FLAT = f"""{_CALL}, rsid, display, zygosity, gene, effect, impact, transcript, hgvs_c, hgvs_p, {_SIG},
            CASE WHEN clndn <> '.' THEN replace(clndn, '_', ' ') END AS condition, CASE WHEN clnrevstat <> '.' THEN replace(clnrevstat, '_', ' ') END AS review_status,
            af AS "global", af_grpmax AS popmax, coalesce(gene IN (SELECT symbol FROM d_warning_genes), false) AS sensitive"""


@query("query_variant", f"SELECT {_FLAT} FROM o_annotated WHERE chrom = '2' AND pos IN (1037, 1038)")
def query_variant(t: Tables) -> DataFrame:
    return variants.query_variant(t.cohort(), position="chr2:1037", genome=ALL_GENOMES)


@query("query_variant_rsid", f"SELECT {_FLAT} FROM o_annotated WHERE rsid = 'rs100' AND ({_KEY}) IN (SELECT {_KEY} FROM d_annotations)")
def query_variant_rsid(t: Tables) -> DataFrame:
    return variants.query_variant(t.cohort(), rsid="rs100", genome=ALL_GENOMES)


_IDS = ["rs50", "rs7", "rs13", "rs100", "rs21", "rs999999999"]
_IDS_SQL = ", ".join(f"({i}, '{rsid}')" for i, rsid in enumerate(_IDS, 1))


_VARIANTS = f"""SELECT cast(r.o AS bigint) AS request_order, r.rsid, c.genome IS NOT NULL AS found, g.genome, c.chrom, c.pos, c.ref, c.alt, c.display,
               c.gene, c.effect, c.impact, replace(c.clnsig, '_', ' ') AS significance, c.af, coalesce(c.gene IN (SELECT symbol FROM d_warning_genes), false) AS sensitive
        FROM (VALUES {_IDS_SQL}) r(o, rsid) CROSS JOIN (VALUES ('g1'), ('g2')) g(genome)
        LEFT JOIN (SELECT * FROM o_annotated WHERE ({_KEY}) IN (SELECT {_KEY} FROM d_annotations)) c ON c.rsid = r.rsid AND c.genome = g.genome"""


@query(
    "query_variants",
    _VARIANTS,
)
def query_variants(t: Tables) -> DataFrame:
    return variants.query_variants(t.cohort("g1", "g2"), _IDS, "g1", "g2")


@query("query_variants_indexed", _VARIANTS)
def query_variants_indexed(t: Tables) -> DataFrame:
    """The same from a stored version of the annotations and the identifier index written with it."""
    store = sinks.LayerStore(t.spark, t.folder())
    store.write("sites", t.annotations)
    cohort = replace(t.cohort("g1", "g2"), annotations=store.read("sites"), rsid_index=store.identifiers("sites"))
    return variants.query_variants(cohort, _IDS, "g1", "g2")


_GENE_COLUMNS = f"genome, symbol, {_KEY}, rsid, display, effect, impact, {_SIG}, af"
_KEEP = "(impact IS NULL OR impact IN ('HIGH', 'MODERATE')) AND (impact IS NOT NULL OR clnsig IS NOT NULL OR rsid IS NOT NULL)"


def _gene_rows(symbols: str, keep: str, per: str, n: int, source: str, truncated: bool = True) -> str:
    return f"""SELECT {_GENE_COLUMNS}, symbol IN (SELECT symbol FROM d_warning_genes) AS sensitive{f', total > {n} AS truncated' if truncated else ''} FROM (
        SELECT v.*, g.symbol, count(*) OVER (PARTITION BY {per}) AS total, row_number() OVER (PARTITION BY {per} ORDER BY {GENOME_RANK.format('v.chrom')}, v.pos, v.ref, v.alt) AS n
        FROM {source} v JOIN o_padded g ON v.chrom = g.chrom AND v.pos BETWEEN g.start_pos AND g.end_pos
        WHERE g.symbol IN ({symbols}) AND {keep}) r WHERE n <= {n}"""


# protected identifiers are those of the asked gene, so the verdict is taken against that gene
_GENE_SMART = """(SELECT a.* FROM o_annotated a WHERE NOT (
    NOT coalesce(rsid IN (SELECT rsid FROM d_pgx_variants WHERE gene = 'BRAND2' AND rsid IS NOT NULL), false) AND coalesce(impact, '') <> 'HIGH'
    AND NOT coalesce(clnsig IN ('Pathogenic', 'Likely_pathogenic', 'Pathogenic/Likely_pathogenic', 'drug_response', 'risk_factor', 'Conflicting_interpretations_of_pathogenicity'), false)
    AND CASE WHEN af IS NOT NULL THEN af > 0.05 AND coalesce(clnsig IN ('Benign', 'Likely_benign', 'Benign/Likely_benign'), true) ELSE clnsig IS NULL END))"""


@query("query_gene", _gene_rows("'BRAND2'", _KEEP, "genome", 50, _GENE_SMART))
def query_gene(t: Tables) -> DataFrame:
    return variants.query_gene(t.cohort(), "brand2", genome=ALL_GENOMES)


@query("query_gene_all", _gene_rows("'BRAND9'", "(impact IS NOT NULL OR clnsig IS NOT NULL OR rsid IS NOT NULL)", "genome", 5, "o_annotated"))
def query_gene_all(t: Tables) -> DataFrame:
    return variants.query_gene(t.cohort(), "BRAND9", "HIGH,MODERATE,LOW,MODIFIER", 5, smart_filter=False, genome=ALL_GENOMES)


@query("query_genes", _gene_rows("'BRAND1', 'BRAND3', 'BRAND5', 'BRAND8', 'BRAND10', 'BRAND24'", _KEEP, "genome, symbol", 20, "o_annotated"))
def query_genes(t: Tables) -> DataFrame:
    return variants.query_genes(t.cohort(), ["BRAND1", "brand3", "BRAND5", "BRAND8", "BRAND10", "brand24", "NOGENE"], genome=ALL_GENOMES)


_ASKED_GENES = "'BRAND1', 'BRAND3', 'BRAND5', 'BRAND8', 'BRAND10', 'BRAND24'"
# which of the asked symbols are unknown depends on the gene table
_UNKNOWN_GENES = """UNION ALL SELECT NULL::varchar AS genome, v.symbol, NULL::varchar AS chrom, NULL::bigint AS pos, NULL::varchar AS ref, NULL::varchar AS alt, NULL::varchar AS rsid,
    NULL::varchar AS display, NULL::varchar AS effect, NULL::varchar AS impact, NULL::varchar AS significance, NULL::double AS af,
    v.symbol IN (SELECT symbol FROM d_warning_genes) AS sensitive, NULL::boolean AS truncated, false AS known
    FROM (VALUES ('BRAND1'), ('BRAND3'), ('BRAND5'), ('BRAND8'), ('BRAND10'), ('BRAND24'), ('NOGENE'), ('NONE-2')) v(symbol) WHERE v.symbol NOT IN (SELECT symbol FROM d_genes)"""


@query("query_genes_unknown", f"SELECT *, true AS known FROM ({_gene_rows(_ASKED_GENES, _KEEP, 'genome, symbol', 20, 'o_annotated')}) k {_UNKNOWN_GENES}")
def query_genes_unknown(t: Tables) -> DataFrame:
    asked = ["BRAND1", "brand3", "BRAND5", "BRAND8", "BRAND10", "brand24", "NoGene", "NOGENE", "none-2"]
    return variants.query_genes(t.cohort(), asked, genome=ALL_GENOMES, report_unknown=True)


@query(
    "query_gene_overview",
    f"""SELECT v.genome, count(*) AS variants, count(*) - count(s.k) AS suppressed, bool_or(v.af IS NOT NULL) AS has_af
        FROM o_annotated v JOIN o_padded g ON v.chrom = g.chrom AND v.pos BETWEEN g.start_pos AND g.end_pos
        LEFT JOIN {_GENE_SMART} s ON s.genome = v.genome AND s.chrom = v.chrom AND s.pos = v.pos AND s.ref = v.ref AND s.alt = v.alt
        WHERE g.symbol = 'BRAND2' AND {_KEEP.replace("impact", "v.impact").replace("clnsig", "v.clnsig").replace("rsid", "v.rsid")} GROUP BY v.genome""",
)
def query_gene_overview(t: Tables) -> DataFrame:
    return variants.gene_overview(t.cohort(), "brand2", genome=ALL_GENOMES)


@query(
    "query_clinvar",
    f"""SELECT {_CALL}, rsid, coalesce(gene, 'Unknown') AS gene, display, {_SIG}, CASE WHEN clndn <> '.' THEN replace(clndn, '_', ' ') END AS condition, total > 50 AS truncated, coalesce(gene IN (SELECT symbol FROM d_warning_genes), false) AS sensitive FROM (
            SELECT *, count(*) OVER (PARTITION BY genome) AS total, row_number() OVER (PARTITION BY genome ORDER BY {_ORDER}) AS n FROM o_annotated
            WHERE contains(lower(clnsig), 'pathogenic') AND clndn <> '.' AND contains(clndn, 'red')) c WHERE n <= 50""",
)
def query_clinvar(t: Tables) -> DataFrame:
    return variants.query_clinvar(t.cohort(), condition="RED", genome=ALL_GENOMES)


@query(
    "query_clinvar_gene",
    f"""SELECT {_CALL}, rsid, coalesce(gene, 'Unknown') AS gene, display, {_SIG}, CASE WHEN clndn <> '.' THEN replace(clndn, '_', ' ') END AS condition, count(*) OVER (PARTITION BY genome) > 50 AS truncated, coalesce(gene IN (SELECT symbol FROM d_warning_genes), false) AS sensitive FROM o_annotated
        WHERE contains(lower(clnsig), 'benign') AND chrom = '4' AND pos BETWEEN (SELECT start_pos FROM o_padded WHERE symbol = 'BRAND4') AND (SELECT end_pos FROM o_padded WHERE symbol = 'BRAND4')""",
)
def query_clinvar_gene(t: Tables) -> DataFrame:
    return variants.query_clinvar(t.cohort(), "Benign", gene="BRAND4", genome=ALL_GENOMES)


@query(
    "query_pgx",
    f"""SELECT 'g1' AS genome, d.drug_name, d.gene, d.cpic_level, v.rsid, v.star_allele, v.chrom, v.pos, v.function_impact, {_STATUS},
               coalesce(d.gene IN (SELECT symbol FROM d_warning_genes), false) AS sensitive
        FROM d_pgx_drugs d JOIN d_pgx_variants v ON d.gene = v.gene LEFT JOIN (SELECT * FROM o_first_calls WHERE genome = 'g1') c ON v.chrom = c.chrom AND v.pos = c.pos
        WHERE d.drug_name = 'nation_3'""",
)
def query_pgx(t: Tables) -> DataFrame:
    return traits.query_pgx(t.cohort("g1"), drug="NATION_3", genome="g1")


@query(
    "query_pgx_all",
    f"""SELECT *, coalesce(gene IN (SELECT symbol FROM d_warning_genes), false) AS sensitive FROM (
            SELECT 'star_alleles' AS part, 'g1' AS genome, d.drug_name, d.gene, d.cpic_level, v.rsid, v.star_allele, v.chrom, v.pos, v.function_impact, {_STATUS},
                   NULL::varchar AS ref, NULL::varchar AS alt, NULL::varchar AS effect, NULL::boolean AS truncated
            FROM d_pgx_drugs d JOIN d_pgx_variants v ON d.gene = v.gene LEFT JOIN (SELECT * FROM o_first_calls WHERE genome = 'g1') c ON v.chrom = c.chrom AND v.pos = c.pos
            WHERE d.drug_name = 'nation_3'
            UNION ALL
            SELECT 'region', genome, NULL, symbol, NULL, rsid, NULL, chrom, pos, NULL, display, ref, alt, effect, total > 2 FROM (
                SELECT v.*, g.symbol, count(*) OVER (PARTITION BY v.genome, g.symbol) AS total,
                       row_number() OVER (PARTITION BY v.genome, g.symbol ORDER BY {GENOME_RANK.format('v.chrom')}, v.pos, v.ref, v.alt) AS n
                FROM o_annotated v JOIN o_padded g ON v.chrom = g.chrom AND v.pos BETWEEN g.start_pos AND g.end_pos
                WHERE v.genome = 'g1' AND v.zygosity <> 'homozygous_ref' AND g.symbol IN (SELECT gene FROM d_pgx_drugs WHERE drug_name = 'nation_3')) r WHERE n <= 2) p""",
)
def query_pgx_all(t: Tables) -> DataFrame:
    return traits.query_pgx(t.cohort("g1"), drug="nation_3", genome="g1", include_all_variants=True, max_results=2)


@query(
    "query_pgx_region",
    f"""SELECT {_CALL}, rsid, display, effect, total > 20 AS truncated FROM (SELECT v.*, count(*) OVER (PARTITION BY genome) AS total, row_number() OVER (PARTITION BY genome ORDER BY {GENOME_RANK.format('v.chrom')}, v.pos, v.ref, v.alt) AS n
        FROM o_annotated v JOIN o_padded g ON v.chrom = g.chrom AND v.pos BETWEEN g.start_pos AND g.end_pos WHERE g.symbol = 'BRAND7' AND v.zygosity <> 'homozygous_ref') r WHERE n <= 20""",
)
def query_pgx_region(t: Tables) -> DataFrame:
    return traits.query_pgx_region(t.cohort(), "BRAND7", ALL_GENOMES)


_GWAS_TOP = """SELECT * FROM (SELECT * FROM d_gwas WHERE contains(mapped_gene, 'BRAND3') AND contains(lower(trait), 'low')
    QUALIFY rsid IS NULL OR row_number() OVER (PARTITION BY rsid ORDER BY p_value NULLS LAST, rsid, trait, study_accession) = 1) d ORDER BY p_value NULLS LAST, rsid NULLS LAST, trait, study_accession LIMIT 30"""


_GWAS_ALL = _GWAS_TOP.removesuffix(" LIMIT 30")


@query(
    "query_gwas",
    f"""SELECT rsid, trait, mapped_gene, p_value, or_beta, first_author, study_accession, (SELECT count(*) FROM ({_GWAS_ALL}) a) > 30 AS truncated,
               cast(row_number() OVER (ORDER BY p_value NULLS LAST, rsid NULLS LAST, trait, study_accession) AS int) AS rank,
               len(list_intersect([trim(x) FOR x IN string_split(mapped_gene, ' - ')], (SELECT list(symbol) FROM d_warning_genes))) > 0 AS sensitive FROM ({_GWAS_TOP}) w""",
)
def query_gwas(t: Tables) -> DataFrame:
    rows = traits.query_gwas(t.cohort(), trait="Low", gene="brand3")
    return rows.select("rsid", "trait", "mapped_gene", "p_value", "or_beta", "first_author", "study_accession", "rank", "truncated", "sensitive")


@query(
    "query_gwas_calls",
    f"""SELECT w.rsid, w.trait, w.p_value, w.study_accession, f.genotype FROM ({_GWAS_TOP}) w LEFT JOIN (
            SELECT a.rsid, c.display || ' (' || CASE c.zygosity WHEN 'homozygous_ref' THEN 'ref' WHEN 'heterozygous' THEN 'het' WHEN 'homozygous_alt' THEN 'hom alt' ELSE 'no call' END || ')' AS genotype
            FROM d_annotations a JOIN o_calls c ON a.chrom = c.chrom AND a.pos = c.pos AND a.ref = c.ref AND a.alt = c.alt WHERE c.genome = 'g5'
            QUALIFY row_number() OVER (PARTITION BY a.rsid ORDER BY c.chrom, c.pos, c.ref, c.alt, c.gt) = 1) f ON w.rsid = f.rsid""",
)
def query_gwas_calls(t: Tables) -> DataFrame:
    rows = traits.query_gwas(t.cohort("g5", "g6"), trait="low", gene="BRAND3", check_calls=True, genome="g5")
    return rows.select("rsid", "trait", "p_value", "study_accession", "genotype")


@query(
    "calculate_prs",
    """SELECT s.genome, s.prs_id, w.trait, round(s.score, 6) AS score, s.found, s.no_call, w.total FROM
           (SELECT genome, prs_id, sum(dosage * weight) AS score, count(*) AS found, count(*) FILTER (WHERE zygosity = 'no_call') AS no_call FROM o_scored WHERE trait = 'Shared trait' GROUP BY genome, prs_id) s
       JOIN (SELECT prs_id, min(trait) AS trait, count(*) AS total FROM d_prs GROUP BY prs_id) w ON s.prs_id = w.prs_id""",
)
def calculate_prs(t: Tables) -> DataFrame:
    return traits.calculate_prs(t.cohort(), trait="shared", genome=ALL_GENOMES).withColumn("score", F.round("score", 6))


@query(
    "genome_summary",
    """SELECT a.genome, count(*) AS total, count(*) FILTER (WHERE kind = 'SNP') AS snps, count(*) FILTER (WHERE kind = 'Indel') AS indels, count(*) FILTER (WHERE contains(alt, ',')) AS multi_allelic,
              count(gene) AS snpeff, count(clnsig) AS clinvar, count(coalesce(af, af_grpmax)) AS gnomad, count(rsid) AS dbsnp,
              count(*) FILTER (WHERE contains(lower(clnsig), 'athogenic')) AS pathogenic, count(DISTINCT gene) FILTER (WHERE contains(lower(clnsig), 'athogenic')) AS pathogenic_genes,
              coalesce(any_value(p.pgx_non_reference), 0)::bigint AS pgx_non_reference, coalesce(any_value(p.pgx_genes), 0) AS pgx_genes
       FROM (SELECT *, CASE WHEN length(ref) = 1 AND len(list_filter(string_split(alt, ','), lambda x: length(x) <> 1)) = 0 THEN 'SNP' ELSE 'Indel' END AS kind FROM o_annotated) a
       LEFT JOIN (SELECT c.genome, count(*) AS pgx_non_reference, count(DISTINCT v.gene) AS pgx_genes FROM d_pgx_variants v JOIN o_first_calls c ON v.chrom = c.chrom AND v.pos = c.pos
                  WHERE v.gene IN ('BRAND1', 'BRAND2', 'BRAND3') AND c.zygosity <> 'homozygous_ref' GROUP BY c.genome) p ON p.genome = a.genome
       GROUP BY a.genome""",
)
def genome_summary(t: Tables) -> DataFrame:
    return overview.genome_summary(t.cohort(), genes=("BRAND1", "BRAND2", "BRAND3"))


@query("list_genomes", "SELECT genome, count(*) AS calls, count(gene) AS snpeff, count(clnsig) AS clinvar, count(coalesce(af, af_grpmax)) AS gnomad, count(rsid) AS dbsnp FROM o_annotated GROUP BY genome")
def list_genomes(t: Tables) -> DataFrame:
    return overview.list_genomes(t.cohort())


@query(
    "calculate_prs_pair",
    """SELECT g.genome, w.prs_id, w.trait, round(coalesce(s.score, 0), 6) AS score, coalesce(s.found, 0) AS found, coalesce(s.no_call, 0) AS no_call, w.total
       FROM (VALUES ('g1'), ('g7')) g(genome) CROSS JOIN (SELECT prs_id, min(trait) AS trait, count(*) AS total FROM d_prs WHERE contains(trait, 'trait') GROUP BY prs_id) w
       LEFT JOIN (SELECT genome, prs_id, sum(dosage * weight) AS score, count(*) AS found, count(*) FILTER (WHERE zygosity = 'no_call') AS no_call FROM o_scored GROUP BY genome, prs_id) s
       ON s.genome = g.genome AND s.prs_id = w.prs_id""",
)
def calculate_prs_pair(t: Tables) -> DataFrame:
    rows = traits.calculate_prs(t.cohort("g1", "g7", "g9"), trait="TRAIT", genome="g1", genome2="g7")
    return rows.withColumn("score", F.round("score", 6))
