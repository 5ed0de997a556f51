"""Layer lifecycle and incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.functions.contigs import accession_table
from allelespan.operators import layers
from allelespan.schemas import CLINICAL_COLUMNS
from allelespan.sources import followed, sinks, vcf
from allelespan.streaming import layer_ingest
from testbed import texts
from testbed.cases_joins import _RELEASE, release
from testbed.cases_sources import read_back
from testbed.registry import Tables, query

_KEY = "chrom, pos, ref, alt"
_COLUMNS = "rsid, rsid_source, gene, effect, impact, transcript, hgvs_c, hgvs_p, clnsig, clndn, clnrevstat, af, af_grpmax"


def four_layers(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four layers, each parsed from its own file spelling."""
    return (
        vcf.effect_layer(read_back(t, texts.site_lines(t, texts.EFFECT_INFO))),
        vcf.clinical_layer(read_back(t, texts.site_lines(t, texts.CLINICAL_INFO, contig="chrom"))),
        vcf.frequency_layer(read_back(t, texts.site_lines(t, texts.FREQUENCY_INFO))),
        vcf.identifier_layer(read_back(t, texts.identifier_lines(t)), accession_table(t.spark)),
    )


@query("layer_full_build", f"SELECT {_KEY}, {_COLUMNS} FROM d_annotations")
def layer_full_build(t: Tables) -> DataFrame:
    return layers.build_annotations(*[layers.one_row_per_site(layer) for layer in four_layers(t)])


@query(
    "layer_clear",
    f"""SELECT {_KEY}, 'clinvar' AS layer, rsid, gene, cast(NULL AS string) AS clnsig, af FROM d_annotations
        UNION ALL SELECT {_KEY}, 'dbsnp', CASE WHEN rsid_source = 'vcf' THEN rsid END, gene, clnsig, af FROM d_annotations
        UNION ALL SELECT {_KEY}, 'gnomad', rsid, gene, clnsig, NULL FROM d_annotations
        UNION ALL SELECT {_KEY}, 'snpeff', rsid, NULL, clnsig, af FROM d_annotations""",
)
def layer_clear(t: Tables) -> DataFrame:
    parts = [
        layers.clear_layer(t.annotations, name).select("chrom", "pos", "ref", "alt", F.lit(name).alias("layer"), "rsid", "gene", "clnsig", "af")
        for name in ("clinvar", "dbsnp", "gnomad", "snpeff")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "layer_refresh",
    f"""SELECT a.chrom, a.pos, a.ref, a.alt, a.rsid, a.gene, l.clnsig, l.clndn, l.clnrevstat, a.af FROM d_annotations a
        LEFT JOIN ({_RELEASE}) l ON a.chrom = l.chrom AND a.pos = l.pos AND a.ref = l.ref AND a.alt = l.alt""",
)
def layer_refresh(t: Tables) -> DataFrame:
    """Layers kept as datasets; the clinical one is replaced by a newer release, the others stay as written."""
    store = sinks.LayerStore(t.spark, t.folder())
    key = ["chrom", "pos", "ref", "alt"]
    store.write("snpeff", t.annotations.select(*key, "rsid", "rsid_source", "gene", "effect", "impact", "transcript", "hgvs_c", "hgvs_p"))
    store.write("clinvar", t.annotations.filter("clnsig IS NOT NULL").select(*key, *CLINICAL_COLUMNS))
    store.write("gnomad", t.annotations.filter("af IS NOT NULL").select(*key, "af", "af_grpmax"))
    store.write("clinvar", release(t))
    rows = layers.build_annotations(store.read("snpeff"), store.read("clinvar"), store.read("gnomad"))
    return rows.select(*key, "rsid", "gene", *CLINICAL_COLUMNS, "af")


_NOW, _BEFORE = "s_acctbal > 2000", "s_acctbal < 8000"
_TOUCHED = "s_nationkey % 3 <> 0"


@query(
    "layer_fingerprint",
    f"""SELECT * FROM (SELECT 'f' || cast(s_suppkey AS string) AS file,
               CASE WHEN NOT ({_BEFORE}) THEN 'new' WHEN NOT ({_NOW}) THEN 'gone' WHEN {_TOUCHED} THEN 'changed' END AS state FROM supplier) s WHERE state IS NOT NULL""",
)
def layer_fingerprint(t: Tables) -> DataFrame:
    """Files of two listings: poor suppliers' are gone, rich ones' are new, and some changed in size or time."""
    name = "'f' || cast(s_suppkey AS string) AS file"
    now = t.sql(f"SELECT {name}, 1000 + s_suppkey AS size, 77 AS modified FROM supplier WHERE {_NOW}")
    size = "CASE WHEN s_nationkey % 3 = 1 THEN 5 ELSE 1000 + s_suppkey END AS size"
    before = t.sql(f"SELECT {name}, {size}, CASE WHEN s_nationkey % 3 = 2 THEN 66 ELSE 77 END AS modified FROM supplier WHERE {_BEFORE}")
    return layers.changed_files(now, before)


# Chromosomes 7 and X come anew, 9 is withdrawn, the rest stays.
_RENEWED = "chrom IN ('7', 'X')"


@query(
    "layer_change_refresh",
    f"""SELECT {_KEY}, clnsig, clndn, false AS rewritten FROM d_sites WHERE clnsig IS NOT NULL AND NOT ({_RENEWED}) AND chrom <> '9'
        UNION ALL SELECT {_KEY}, clnsig, clndn, true FROM ({_RELEASE}) r WHERE clnsig IS NOT NULL AND {_RENEWED}""",
)
def layer_change_refresh(t: Tables) -> DataFrame:
    """A layer that follows its files: one a chromosome, of which two are replaced and one is withdrawn; which data files are new tells what was rewritten."""
    site = "concat_ws('\t', 'chr' || chrom, cast(pos AS string), '.', ref, alt, '.', '.', {}) AS value, chrom AS file_key"
    old = texts.write_files(t, t.sql(f"SELECT {site.format(texts.CLINICAL_INFO)} FROM d_sites"), ["##old"])
    info = "concat_ws(';', 'CLNSIG=' || clnsig, 'CLNDN=' || clndn)"
    new = texts.write_files(t, t.sql(f"SELECT {site.format(info)} FROM ({_RELEASE}) r WHERE {_RENEWED}"), ["##new"])
    path, chroms = t.folder(), [row.chrom for row in t.sites.select("chrom").distinct().collect()]  # 25 of them
    followed.FollowedLayer(t.spark, path, [f"{old}/file_key={chrom}" for chrom in chroms], vcf.clinical_layer).refresh()
    names = t.folder()
    t.spark.read.parquet(path).select(F.col("_metadata.file_name").alias("name")).distinct().write.parquet(names)
    kept = [f"{old}/file_key={chrom}" for chrom in chroms if chrom not in ("7", "9", "X")]
    followed.FollowedLayer(t.spark, path, [*kept, new], vcf.clinical_layer).refresh()
    before = F.broadcast(t.spark.read.parquet(names)).withColumn("rewritten", F.lit(False))  # a name for each file of 25 folders
    rows = t.spark.read.parquet(path).withColumn("name", F.col("_metadata.file_name")).join(before, "name", "left")
    return rows.select(F.col("chrom").cast("string").alias("chrom"), "pos", "ref", "alt", "clnsig", "clndn", F.coalesce("rewritten", F.lit(True)).alias("rewritten"))


@query("layer_parity", "SELECT count(*) AS rows, 0::bigint AS differing FROM d_annotations")
def layer_parity(t: Tables) -> DataFrame:
    """A build chromosome by chromosome group and out of order equals the build in one go."""
    effects, clinical, frequency, identifiers = [
        t.annotations.select("chrom", "pos", "ref", "alt", *names)
        for names in (
            ["rsid", "rsid_source", "gene", "effect", "impact", "transcript", "hgvs_c", "hgvs_p"], CLINICAL_COLUMNS, ["af", "af_grpmax"], ["rsid"],
        )
    ]
    own = effects.withColumn("rsid", F.when(F.col("rsid_source") == "vcf", F.col("rsid"))).withColumn("rsid_source", F.when(F.col("rsid").isNotNull(), "vcf"))
    whole = layers.build_annotations(own, clinical, frequency, identifiers)
    empty = own
    for name in [*CLINICAL_COLUMNS, "af", "af_grpmax"]:
        empty = empty.withColumn(name, F.lit(None).cast("double" if name.startswith("af") else "string"))
    late = F.col("chrom").isin("X", "Y", "MT", "2", "9")
    stepwise = layers.update_layer(empty, frequency.filter(late), ["af", "af_grpmax"])
    stepwise = layers.backfill_rsids(stepwise, identifiers)
    stepwise = layers.update_layer(stepwise, clinical, CLINICAL_COLUMNS)
    stepwise = layers.update_layer(stepwise, frequency.filter(~late), ["af", "af_grpmax"])
    parts = [whole.select(F.lit(1).alias("row"), F.lit(0).alias("copies")), layers.differing_rows(whole, stepwise).select(F.lit(0).alias("row"), "copies")]
    return parts[0].unionByName(parts[1]).agg(F.sum("row").alias("rows"), F.sum("copies").alias("differing"))


# effect records arrive order by order: the site's record of the latest order counts
_ARRIVALS = "SELECT l_partkey AS k, o_orderpriority AS priority, max(l_orderkey) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey, o_orderpriority"


@query(
    "stream_layer_ingest",
    f"""SELECT chrom, pos, ref, alt, 'sig_' || cast(o AS string) AS clnsig, 'batch ' || priority AS clndn, cast(NULL AS string) AS clnrevstat
        FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority DESC) AS n FROM ({_ARRIVALS}) a) b JOIN d_sites USING (k) WHERE n = 1""",
)
def stream_layer_ingest(t: Tables) -> DataFrame:
    """Five deliveries (one per priority) land one after the other; each is streamed in before the next arrives."""
    folder = t.folder()
    info = "'CLNSIG=sig_' || cast(o AS string) || ';CLNDN=batch ' || priority"
    line = f"concat_ws('\t', 'chr' || chrom, cast(pos AS string), '.', ref, alt, '.', '.', {info})"
    deliveries = t.sql(f"SELECT {line} AS value, priority FROM ({_ARRIVALS}) a JOIN d_sites USING (k)")
    for priority in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        deliveries.filter(F.col("priority") == priority).select("value").write.mode("append").text(f"{folder}/landing")
        layer_ingest.start_layer_stream(t.spark, f"{folder}/landing", f"{folder}/store", f"{folder}/checkpoint", vcf.clinical_layer).awaitTermination()
    return layer_ingest.current_layer(t.spark, f"{folder}/store")


@query(
    "stream_layer_compacted",
    f"""SELECT chrom, pos, ref, alt, 'sig_' || cast(o AS string) AS clnsig, 'batch ' || priority AS clndn, cast(NULL AS string) AS clnrevstat
        FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority DESC) AS n FROM ({_ARRIVALS}) a) b JOIN d_sites USING (k) WHERE n = 1""",
)
def stream_layer_compacted(t: Tables) -> DataFrame:
    """The same deliveries with a compaction after each; the published version comes from the merged runs and the last increment."""
    folder = t.folder()
    info = "'CLNSIG=sig_' || cast(o AS string) || ';CLNDN=batch ' || priority"
    line = f"concat_ws('\t', 'chr' || chrom, cast(pos AS string), '.', ref, alt, '.', '.', {info})"
    deliveries = t.sql(f"SELECT {line} AS value, priority FROM ({_ARRIVALS}) a JOIN d_sites USING (k)")
    layers_store = sinks.LayerStore(t.spark, f"{folder}/layers")
    for priority in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        deliveries.filter(F.col("priority") == priority).select("value").write.mode("append").text(f"{folder}/landing")
        layer_ingest.start_layer_stream(t.spark, f"{folder}/landing", f"{folder}/store", f"{folder}/checkpoint", vcf.clinical_layer).awaitTermination()
        layer_ingest.publish(t.spark, f"{folder}/store", layers_store, "clinvar", fan=2)
    return layers_store.read("clinvar")
