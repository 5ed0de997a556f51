"""A layer that follows its source files: only what a change touches is rebuilt, and the rows are those of a full build."""

import os

import pytest
from pyspark.sql import functions as F

from allelespan.operators.layers import one_row_per_site
from allelespan.sources import vcf
from allelespan.sources.followed import FollowedLayer
from helpers import rows_of


def put(folder, name, *records):
    """A file of (chrom, pos, significance) records."""
    folder.mkdir(exist_ok=True)
    lines = [f"{chrom}\t{pos}\t.\tA\tG\t.\tPASS\tCLNSIG={word}" for chrom, pos, word in records]
    (folder / name).write_text("\n".join(["##fileformat=VCFv4.2", *lines, ""]))


def layer_files(path):
    """Names of the data files by chromosome folder."""
    return {folder.name: sorted(f.name for f in folder.iterdir() if f.suffix == ".parquet") for folder in path.iterdir() if folder.name.startswith("chrom=")}


@pytest.fixture
def followed(spark, tmp_path):
    raw = tmp_path / "raw"
    put(raw, "one.vcf", ("chr1", 5, "Benign"), ("chr1", 9, "Benign"))
    put(raw, "two.vcf", ("chr2", 5, "Benign"), ("chrX", 7, "Pathogenic"))
    put(raw, "three.vcf", ("2", 5, "Pathogenic"), ("2", 8, "Benign"), ("HLA:01*02", 3, "Benign"))
    put(raw, "none.vcf")
    layer = FollowedLayer(spark, str(tmp_path / "layer"), str(raw), vcf.clinical_layer)
    return raw, tmp_path / "layer", layer


def same_as_full_build(spark, raw, layer):
    full = one_row_per_site(vcf.clinical_layer(vcf.read_vcf_lines(spark, str(raw))))
    return rows_of(layer.read()) == rows_of(full)


def test_first_refresh_is_a_full_build_and_the_second_does_nothing(spark, followed):
    raw, path, layer = followed
    assert layer.read() is None and {r.state for r in layer.changes().collect()} == {"new"}
    first = layer.refresh()
    assert first.record == 1 and first.chromosomes == ["1", "2", "HLA:01*02", "X"] and len(first.files) == 3
    assert same_as_full_build(spark, raw, layer)
    before = layer_files(path)
    assert layer.refresh() == (None, [], []) and layer_files(path) == before
    assert layer.record().filter(F.col("chrom").isNull()).count() == 1  # the file without rows is known all the same


def test_a_changed_file_rewrites_its_chromosome_only(spark, followed):
    raw, path, layer = followed
    layer.refresh()
    before = layer_files(path)
    put(raw, "one.vcf", ("chr1", 5, "Likely_benign"))
    assert [(r.file.rsplit("/", 1)[1], r.state) for r in layer.changes().collect()] == [("one.vcf", "changed")]
    done = layer.refresh()
    after = layer_files(path)
    assert done.chromosomes == ["1"] and len(done.files) == 1
    assert {name for name in after if after[name] != before[name]} == {"chrom=1"}
    assert same_as_full_build(spark, raw, layer)


def test_a_chromosome_shared_by_files_is_rebuilt_from_all_of_them(spark, followed):
    raw, path, layer = followed
    layer.refresh()
    before = layer_files(path)
    put(raw, "three.vcf", ("2", 8, "Likely_benign"))  # its row for 2:5 is gone, and the scaffold with it
    done = layer.refresh()
    after = layer_files(path)
    assert done.chromosomes == ["2", "HLA:01*02"] and [f.rsplit("/", 1)[1] for f in done.files] == ["three.vcf", "two.vcf"]
    assert set(after) == {"chrom=1", "chrom=2", "chrom=X"} and after["chrom=X"] == before["chrom=X"]
    assert same_as_full_build(spark, raw, layer)


def test_gone_and_new_files(spark, followed):
    raw, path, layer = followed
    layer.refresh()
    os.remove(raw / "two.vcf")
    put(raw, "four four.vcf", ("22", 1, "Benign"))  # a name that has to be escaped
    done = layer.refresh()
    assert done.chromosomes == ["2", "22", "X"] and "chrom=X" not in layer_files(path)
    assert same_as_full_build(spark, raw, layer) and layer.refresh().record is None
    for name in os.listdir(raw):
        os.remove(raw / name)
    assert layer.refresh().files == [] and layer.read() is None


def test_a_lost_refresh_is_done_again(spark, followed):
    raw, path, layer = followed
    layer.refresh()
    put(raw, "one.vcf", ("chr1", 77, "Benign"))
    layer.refresh()
    os.remove(path / "_inputs" / "n=2" / "_SUCCESS")  # the job ended before its record was whole
    assert [r.state for r in layer.changes().collect()] == ["changed"]
    assert layer.refresh().record == 2 and same_as_full_build(spark, raw, layer)
