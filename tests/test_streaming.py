"""Incremental layer ingest."""

import os
import shutil

from allelespan.sources import vcf
from allelespan.sources.sinks import LayerStore
from allelespan.streaming import layer_ingest
from helpers import rows_of


def line(pos, sig, alt="G"):
    return f"chr1\t{pos}\t.\tA\t{alt}\t.\t.\tCLNSIG={sig}\n"


def ingest(spark, base, per_batch=1000):
    layer_ingest.start_layer_stream(spark, f"{base}/landing", f"{base}/store", f"{base}/checkpoint", vcf.clinical_layer, per_batch).awaitTermination()
    return layer_ingest.current_layer(spark, f"{base}/store").select("pos", "alt", "clnsig")


def test_later_deliveries_win_and_nothing_is_read_twice(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.vcf").write_text("##header\n" + line(1, "Benign") + line(2, "Benign") + "1\t9\t.\tA\tG\t.\t.\tDP=1\n")
    assert rows_of(ingest(spark, tmp_path)) == [(1, "G", "Benign"), (2, "G", "Benign")]
    (landing / "b.vcf").write_text(line(2, "Pathogenic") + line(2, "risk_factor", "T"))
    expected = [(1, "G", "Benign"), (2, "G", "Pathogenic"), (2, "T", "risk_factor")]
    assert rows_of(ingest(spark, tmp_path)) == expected
    assert rows_of(ingest(spark, tmp_path)) == expected  # nothing new
    assert len(list((tmp_path / "store").glob("increment=*"))) == 2
    layers = LayerStore(spark, str(tmp_path / "layers"))
    assert layer_ingest.publish(spark, f"{tmp_path}/store", layers, "clinvar") == 1
    assert rows_of(layers.read("clinvar").select("pos", "alt", "clnsig")) == expected


def test_a_batch_run_again_overwrites_itself(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.vcf").write_text(line(1, "Benign"))
    before = rows_of(ingest(spark, tmp_path))
    # the commit mark of the batch is lost, as after a crash between storing and committing
    for mark in (tmp_path / "checkpoint" / "commits").glob("*0*"):
        mark.unlink()
    assert rows_of(ingest(spark, tmp_path)) == before
    assert len(list((tmp_path / "store").glob("increment=*"))) == 1


def test_copies_within_a_batch_become_one_row(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.vcf").write_text(line(1, "Benign") * 3 + line(1, "Affects"))
    assert rows_of(ingest(spark, tmp_path)) == [(1, "G", "Affects")]


def test_batches_do_not_change_the_answer(spark, tmp_path):
    """Later files win whether files come one by one or together; a lost checkpoint changes nothing."""
    results = []
    for per_batch in (1, 2, 1000):
        base = tmp_path / str(per_batch)
        landing = base / "landing"
        landing.mkdir(parents=True)
        for number, sig in enumerate(["Benign", "Pathogenic", "Affects", "Likely_benign", "drug_response"]):
            file = landing / f"{'edcba'[number]}.vcf"  # names in the opposite order of time
            file.write_text(line(1, sig) + line(10 + number, sig) + line(3, "first") + line(3, f"last_{number}"))
            os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))
        results.append(rows_of(ingest(spark, base, per_batch)))
        shutil.move(base / "checkpoint", base / "lost")
        assert rows_of(ingest(spark, base, 3)) == results[-1]
    assert results[0] == results[1] == results[2]
    assert results[0][0] == (1, "G", "drug_response") and (3, "G", "last_4") in results[0] and len(results[0]) == 7


def increments(spark, store, numbers, sites=40):
    """Increments as batches write them: each brings newer rows of half of the sites."""
    for n in numbers:
        rows = [("1", k, "A", "G", f"s{n}", None, None, n, f"f{n}", 0, k) for k in range(sites) if (k + n) % 2 == 0]
        schema = "chrom string, pos long, ref string, alt string, clnsig string, clndn string, clnrevstat string, file_time int, file_name string, split_start long, line long"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{store}/increment=q-{n:08d}")


def test_levels_keep_what_has_to_be_read_small(spark, tmp_path):
    store = str(tmp_path / "store")
    increments(spark, store, range(4))
    assert layer_ingest.compact(spark, store, fan=4) == 1
    read = []
    for n in range(4, 21):
        increments(spark, store, [n])
        layer_ingest.compact(spark, store, fan=4)
        read.append(sum(spark.read.option("recursiveFileLookup", "true").parquet(f"{store}/{name}").count() for name, _ in layer_ingest.Runs(spark, store).live()))
    assert max(read) <= 4 * 40 + 3 * 20 and len(layer_ingest.Runs(spark, store).live()) <= 6  # 21 increments hold 420 rows
    want = [(k, f"s{20 if k % 2 == 0 else 19}") for k in range(40)]
    assert rows_of(layer_ingest.current_layer(spark, store).select("pos", "clnsig")) == sorted(want, key=repr)
    # a batch that runs again, also as another stream after its checkpoint was lost, changes nothing
    increments(spark, store, [2, 19])
    shutil.copytree(f"{store}/increment=q-00000003", f"{store}/increment=other-00000000")
    layer_ingest.compact(spark, store, fan=2)
    assert rows_of(layer_ingest.current_layer(spark, store).select("pos", "clnsig")) == sorted(want, key=repr)


def test_a_lost_compaction_leaves_nothing_to_readers(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    increments(spark, store, range(3))
    before = rows_of(layer_ingest.current_layer(spark, store))
    runs = layer_ingest.Runs(spark, store)
    monkeypatch.setattr(layer_ingest.json, "dumps", lambda entry: '{"number": 0')  # the entry is cut off
    runs.merge([name for name, _ in runs.live()], 1)
    monkeypatch.undo()
    assert len(runs.live()) == 3 and rows_of(layer_ingest.current_layer(spark, store)) == before
    assert layer_ingest.compact(spark, store, fan=3) == 1 and len(runs.live()) == 1
    assert rows_of(layer_ingest.current_layer(spark, store)) == before
