"""Counting, encoding, decoding and shards against the tokenizer libraries."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import awkward

from allelespan.llm import sentencepiece_codec, token_counts, token_shards
from allelespan.llm.pieces import vocabulary
from allelespan.session import shared_folder

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("▁ \n\tabteins<>0é日\U0001d518", max_size=60)))
def test_texts_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    with open(MODEL, "rb") as file:
        model = file.read()
    vocab = vocabulary(model)
    want = LIBRARY.encode(text)
    assert sum(token_counts.count_part(vocab, p) for p in vocab.parts(text)) == len(want)
    _, known = sentencepiece_codec._encoder(model)
    assert [i for p in vocab.parts(text) for i in np.frombuffer(known[p], dtype=np.int32).tolist()] == want


def test_columns_equal_the_library(odd, nothing):
    texts = [r[1] or "" for r in awkward()]
    want = [LIBRARY.encode(t) for t in texts]
    assert Counter(r.n_tokens for r in token_counts.count_tokens(odd, MODEL).collect()) == Counter(map(len, want))
    coded = sentencepiece_codec.encode(odd, MODEL)
    assert dict(coded.dtypes)["ids"] == "array<int>" and dict(coded.dtypes)["score"] == "string"
    decoded = sentencepiece_codec.decode(coded, MODEL)
    assert Counter((tuple(r.ids), r.decoded) for r in decoded.collect()) == Counter((tuple(ids), LIBRARY.decode(ids)) for ids in want)
    both = sentencepiece_codec.round_trip(odd, MODEL)
    assert Counter((tuple(r.ids), r.decoded) for r in both.collect()) == Counter((tuple(r.ids), r.decoded) for r in decoded.collect())
    report = {r.doc_id: r for r in token_counts.token_report(odd, MODEL).collect()}
    assert report[12].over_limit and not report[1].over_limit and report[1].n_bytes == 0
    assert token_counts.count_tokens(nothing, MODEL).count() == sentencepiece_codec.round_trip(nothing, MODEL).count() == 0


def test_pair_tests_look_up_each_neighbour_once():
    """The merges of two tokens' characters look up a pair when it comes up, not all pairs again after each merge."""

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    with open(MODEL, "rb") as file:
        encoder = sentencepiece_codec.PrefixEncoder(vocabulary(file.read()))
    words = [piece for piece in encoder.vocab.ids if len(piece) >= 8][:200]
    own, encoder.vocab.ranks = encoder.vocab.ranks, Counted(encoder.vocab.ranks)
    try:
        got = [encoder._merges_to(word + "s", len(word) + 1) for word in words]
    finally:
        encoder.vocab.ranks = own
    assert Counted.asked <= sum(3 * len(word) + 3 for word in words)
    assert ["".join(symbols) for symbols in got] == [word + "s" for word in words]


def test_any_ids_decode_as_the_library_does(frame):
    rnd = random.Random(4)
    lists = [[rnd.randrange(3, 32000) for _ in range(12)] for _ in range(60)] + [[rnd.randrange(3, 259) for _ in range(6)] for _ in range(60)]
    got = sentencepiece_codec.decode(frame([(k, x) for k, x in enumerate(lists)] + [(-1, None), (-2, [None, 40000])], "k bigint, ids array<int>"), MODEL).collect()
    texts = {r.k: r.decoded for r in got}
    assert texts[-1] == "" and texts[-2] == " ⁇  ⁇ "
    assert [texts[k] for k in range(len(lists))] == [LIBRARY.decode(x) for x in lists]


@pytest.mark.parametrize("count", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_slots_are_a_permutation(count):
    got = token_shards.slots(np.arange(count), count, key=9)
    assert sorted(got.tolist()) == list(range(count))
    assert count < 100 or (token_shards.slots(np.arange(count), count, key=8) != got).any()


def test_shards_hold_every_id_once_in_slot_order(spark, odd, nothing):
    folder, written = shared_folder(spark), shared_folder(spark)
    odd.coalesce(2).write.parquet(folder)
    table = spark.read.parquet(folder)
    manifest = sorted(token_shards.write_shards(table, written, RANKS, public_tokenizers.PATTERN, length=64, per_shard=100).collect())
    sequences = list(token_shards.read_from(written, 0, 64, 100))
    assert [r.slot for r in manifest] == list(range(len(sequences))) and len(sequences) > 300
    assert all(r.shard == r.slot // 100 and r.byte_offset == r.slot % 100 * 128 for r in manifest)
    assert [r.crc32 for r in manifest] == [zlib.crc32(s.tobytes()) for s in sequences]
    assert [s.tolist() for s in token_shards.read_from(written, 250, 64, 100)] == [s.tolist() for s in sequences[250:]]
    with open(RANKS, "rb") as file:
        encoding, end = token_shards._encoding(file.read(), public_tokenizers.PATTERN)
    assert isinstance(encoding, tiktoken.Encoding)
    want = Counter()
    for text in (r[1] for r in awkward()):
        want.update([*encoding.encode_ordinary(text), end] if text else [])
    got = Counter()
    for r, s in zip(manifest, sequences):
        got.update(s[: r.n_tokens].tolist())
        assert set(s[r.n_tokens :].tolist()) <= {end}
    assert got == want
    assert token_shards.write_shards(nothing, shared_folder(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_shards_read_each_text_once(spark):
    """Rows that come out otherwise when read again, as of a random sample, still give one whole order."""

    def made(batches):
        for batch in batches:
            texts = ["".join(random.SystemRandom().choices("abcdefgh ", k=400)) for _ in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])

    written = shared_folder(spark)
    manifest = sorted(token_shards.write_shards(spark.range(0, 200, 1, 3).mapInArrow(made, "text string"), written, RANKS, public_tokenizers.PATTERN, length=64, per_shard=100).collect())
    sequences = list(token_shards.read_from(written, 0, 64, 100))
    assert [r.slot for r in manifest] == list(range(len(sequences))) and len(sequences) > 300
    assert [r.crc32 for r in manifest] == [zlib.crc32(s.tobytes()) for s in sequences]
    with open(RANKS, "rb") as file:
        end = token_shards._encoding(file.read(), public_tokenizers.PATTERN)[1]
    assert sum(int((s[: r.n_tokens] == end).sum()) for r, s in zip(manifest, sequences)) == 200


def test_shards_from_many_small_blocks(spark, monkeypatch):
    """Blocks of a few sequences, dealt several times by a task, come to the order of large ones."""
    texts = spark.createDataFrame([(f"{k} " * (k % 90),) for k in range(600)], "text string").repartition(3)
    folder = shared_folder(spark)
    texts.write.parquet(folder)
    got = []
    for sizes in ((1 << 20, 32 << 20), (256, 1024)):
        monkeypatch.setattr(token_shards, "_BLOCK_BYTES", sizes[0])
        monkeypatch.setattr(token_shards, "_HELD_BYTES", sizes[1])
        written = shared_folder(spark)
        manifest = token_shards.write_shards(spark.read.parquet(folder), written, RANKS, public_tokenizers.PATTERN, length=16, per_shard=50)
        got.append((sorted(manifest.collect()), [s.tolist() for s in token_shards.read_from(written, 0, 16, 50)]))
    assert got[0] == got[1] and len(got[0][0]) > 1000
