"""Every stage of the corpus pipeline and the whole of it against plain versions of its stages."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from panelspark.llm import tokens
from tests.llm import brute, corpus


def plain_rows(df):
    return Counter(str(r) for r in df.collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    corpus.clashing(spark).write.parquet(f"{path}/documents.parquet")
    corpus.benchmark(spark).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_quality_keeps_rows_as_they_are(spark, folder):
    docs = corpus.clashing(spark)
    out = corpus_pipeline.quality(spark, docs, folder)
    kept = plain_rows(out)
    assert out.columns == docs.columns and not kept - plain_rows(docs)
    texts = {r.text for r in out.collect()}
    assert corpus.rows()[0][1] in texts and None not in texts and "" not in texts and "one two three" not in texts and "again " * 60 not in texts


def test_one_of_every_class_stays(spark, folder):
    given = corpus.rows()
    out = corpus_pipeline.near_duplicates(spark, corpus.clashing(spark), folder)
    assert out.columns == corpus.clashing(spark).columns
    classes = brute.similar([(i, r[1]) for i, r in enumerate(given)])
    left = Counter(str((r.doc_id, r.text)) for r in out.collect())
    of = {str((r[0], r[1])): c for r, c in zip(given, classes, strict=True)}
    assert Counter(of[k] for k in left.elements()) == Counter(set(classes))
    for key in left:  # the least id of the class, null last
        ids = [g[0] for g, c in zip(given, classes, strict=True) if c == of[key]]
        assert key.startswith(f"({min((i for i in ids if i is not None), default=None)},")


def test_contaminated_documents_go(spark, folder):
    given, items = corpus.rows(), [r.text for r in corpus.benchmark(spark).collect()]
    out = corpus_pipeline.decontaminate(spark, corpus.clashing(spark), folder)
    want = Counter(str((r[0], r[1])) for r in given if not brute.contaminated(r[1], items))
    assert Counter(str((r.doc_id, r.text)) for r in out.collect()) == want and sum(want.values()) < len(given)


def test_mixture_repeats_whole_rows(spark, folder):
    docs = corpus.clashing(spark)
    out = corpus_pipeline.mixture(spark, docs, folder)
    have, told = plain_rows(docs), plain_rows(out)
    assert out.columns == docs.columns and set(told) <= set(have)
    assert all(n <= 3 * have[r] for r, n in told.items())


def test_files_of_the_last_stage(spark, folder):
    docs = corpus.clashing(spark)
    tk = __import__("tokenizers").Tokenizer.from_file(tokens.public_tokenizer(spark))
    out = corpus_pipeline.token_files(spark, docs, folder).collect()
    want = Counter((r.doc_id, len(tk.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in out) == want


def test_run_is_its_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
    assert plain_rows(corpus_pipeline.run(spark, folder)) == plain_rows(docs) and sizes[0] < 60 and sizes[1] < sizes[0] and sizes[2] < sizes[1]


def test_an_empty_corpus(spark, tmp_path):
    corpus.clashing(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    corpus.benchmark(spark).limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
