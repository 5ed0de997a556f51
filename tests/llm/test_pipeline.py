"""Every stage of the pipeline against plain searches over what the stage before kept."""

import public_tokenizers
import pytest
import sentencepiece
from test_decontamination import expected as contaminated
from test_ngram_join import shingles, similar

import corpus_pipeline
from allelespan.llm.queries import op4_toxicity, table
from allelespan.llm.toxicity import held_out
from llm_fixtures import components

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns, written and reread as the next one's documents."""
    out, docs = [], table(spark, SF_DIR, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR))
        out.append({r.doc_id: r for r in docs.collect()})
    return out


def test_toxic_documents_go(spark, kept):
    """By the stage's own query, and by the labels that training never saw."""
    assert set(kept[0]) == {r.doc_id for r in op4_toxicity(spark, SF_DIR).collect() if not r.predicted}
    labels = {r.doc_id: r.toxic for r in table(spark, SF_DIR, "labels").filter(held_out("doc_id")).collect()}
    clean = [i for i, t in labels.items() if not t]
    assert len(clean) > 5 and sum(i in kept[0] for i in clean) >= len(clean) - 1
    assert len(kept[0]) >= 180  # about a tenth of the documents are toxic


def test_one_of_each_group_stays(kept):
    sets = {i: shingles(r.text) for i, r in kept[0].items()}
    links = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])]
    assert links and set(kept[1]) == set(components(sets, links).values())


def test_contaminated_documents_go(spark, kept):
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    clean = {i for i, r in kept[1].items() if not contaminated(r.text, items)[1]}
    assert set(kept[2]) == clean and len(clean) < len(kept[1])


def test_personal_data_is_replaced_in_place(kept):
    assert set(kept[3]) == set(kept[2])
    changed = [i for i in kept[2] if kept[2][i].text != kept[3][i].text]
    assert changed and all(len(kept[2][i].text) == len(kept[3][i].text) for i in changed)
    assert all(kept[2][i].asDict() | {"text": ""} == kept[3][i].asDict() | {"text": ""} for i in kept[2])


def test_ids_are_the_librarys(kept):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(kept[4]) == set(kept[3])
    for i, r in kept[4].items():
        assert r.ids == library.encode(kept[3][i].text) and r.n_tokens == len(r.ids)


def test_awkward_rows_pass_every_stage(spark, odd, nothing):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = odd.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "'s' AS source", "CAST(NULL AS bigint) AS n_chars")
    for rows, least in ((docs, 8), (spark.createDataFrame([], columns), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, rows = rows.columns, corpus_pipeline.written(stage(spark, rows, SF_DIR))
            assert rows.columns == before
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF_DIR).count() >= least
