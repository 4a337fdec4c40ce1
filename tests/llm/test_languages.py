import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm.languages import LANGUAGES, batch_segments, document_segments, fit_model, label_cases, label_of, language_segments, mixture, sentences, training_sample

EN, DE, ES = "Please confirm the delivery date for this order as soon as you can.", "Bitte bestätigen Sie den Liefertermin für diese Bestellung so bald wie möglich.", "Les rogamos que confirmen la fecha de entrega de este pedido lo antes posible."


@pytest.fixture(scope="module")
def model(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    return fit_model([(r.code, list(r.sentences)) for r in training_sample(docs).collect()])


def found(spark, model, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return language_segments(docs, model).orderBy("doc_id", "segment_no").collect()


def test_labels():
    assert [label_of(x) for x in ("en_GB", "DE", "deu", "Deutsch", "español", "pt-PT", "polski", "dut")] == ["en", "de", "de", "de", "es", "pt", "pl", "nl"]
    assert [label_of(x) for x in (None, "", "und", "xx", "n/a", "unknown", " ")] == [None] * 7


def test_sentences():
    text = "Purchase Order PO-1\nOrder Date: 1.2.2025\n10 | TR-1 | 5 | 1.00\nDear all,\n\nThe price of 1.50 EUR is fine. We would like to order more.\nTR-1 Filterpatronen\nKind regards\n"
    assert sentences(text) == ["The price of 1.50 EUR is fine.", "We would like to order more."]
    assert sentences("One two three four. / Uno dos tres cuatro.") == ["One two three four.", "Uno dos tres cuatro."]
    assert sentences(None) == sentences("") == sentences("  \n") == sentences("123 456") == []


def test_segments(spark, model):
    r = found(spark, model, [(1, f"{EN} {EN}\n{DE} {DE}\n\n{ES}", "en"), (2, f"{DE}\nKX-1 filter cartridges\n{DE}", None), (3, None, "en"), (4, "", "en"), (5, "10 20 30", None), (6, EN, "en"), (6, EN, "en")])
    assert [(x.doc_id, x.segment_no, x.lang, x.n_segments) for x in r] == [(1, 0, "en", 3), (1, 1, "de", 3), (1, 2, "es", 3), (2, 0, "de", 1), (3, 0, None, 1), (4, 0, None, 1), (5, 0, None, 1), (6, 0, "en", 1), (6, 0, "en", 1)]
    assert all(x.confidence > 0.9 for x in r if x.lang) and all(x.confidence == 0 for x in r if not x.lang)


def test_cases(spark, data):
    rows = [(1, EN, "en-US"), (2, EN, "de"), (3, EN, "xx"), (4, f"{EN} {DE}", "en"), (5, "1 2 3", None)]
    base = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", "lang")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").unionByName(base).withColumns({c: F.lit("z") for c in ("label", "h", "code", "segment_no", "confidence", "s")})
    cases = sorted(tuple(r) for r in label_cases(docs).where("doc_id < 100").collect())
    assert cases == [(2, 0, "en"), (3, 0, "en"), (4, 0, "en"), (4, 1, "de")]


def test_held_out_accuracy(spark, model, data):
    """Labels of documents that are surely outside the sample: nearly all disagreements are planted, so most labels agree."""
    fitted_on = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").select("text")
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.1") + "/documents.parquet").join(fitted_on, "text", "left_anti")
    labelled = [(label_of(r.label), r.lang, r.confidence) for r in language_segments(docs, model).where("n_segments = 1 and lang is not null").collect()]
    known = [(a, b) for a, b, _ in labelled if a]
    assert len(known) > 4_000 and sum(a == b for a, b in known) > 0.85 * len(known)
    # sure of nearly all of them
    assert sum(c > 0.9 for *_, c in labelled) > 0.98 * len(labelled)


def test_sample_is_bounded_and_the_same_at_each_run(spark):
    rows = [(None, f"{EN} {EN} {EN}", "en")] * 50 + [(k, f"Item {k}. {DE} {DE} {DE} " * (1 + 30 * (k == 7)), "de") for k in range(300)] + [(k, None, "fr") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = [sorted((r.code, tuple(r.sentences)) for r in training_sample(d, 20).collect()) for d in (docs, docs.repartition(5))]
    assert got[0] == got[1]
    assert sum(c == "de" for c, _ in got[0]) == 20 and sum(c == "en" for c, _ in got[0]) == 1 and max(len(x) for _, x in got[0]) <= 40


def test_batches_as_one_by_one():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 12, 300)
    ll = rng.normal(-60, 6, (sizes.sum(), len(LANGUAGES)))
    ll[np.arange(len(ll)), rng.integers(0, 2, len(ll))] += rng.choice([0, 20, 40], len(ll))
    found, at = batch_segments(ll, sizes), 0
    for n, segments in zip(sizes, found, strict=True):
        alone = document_segments(ll[at : at + n]) if n else [(None, 0.0, 0)]
        assert [(a, c) for a, _, c in segments] == [(a, c) for a, _, c in alone] and np.allclose([b for _, b, _ in segments], [b for _, b, _ in alone])
        at += n


def test_mixture_picks_no_more_languages_than_needed():
    rng = np.random.default_rng(1)
    one = np.full((20, len(LANGUAGES)), -60.0) + rng.normal(0, 1, (20, len(LANGUAGES)))
    one[:, 2] += 40
    assert mixture(one)[0].tolist() == [2]
    one[5:9, 4] += 80
    chosen, resp = mixture(one)
    assert sorted(chosen.tolist()) == [2, 4] and np.allclose(resp.sum(axis=1), 1)
    assert [(a, n) for a, _, n in document_segments(one)] == [(LANGUAGES[2], 5), (LANGUAGES[4], 4), (LANGUAGES[2], 11)]


def test_long_and_empty(spark, model):
    long = f"{EN} " * 20_000
    r = found(spark, model, [(1, long, None)])
    assert [(x.lang, x.n_sentences) for x in r] == [("en", 20_000)]
    assert language_segments(spark.createDataFrame([], "doc_id bigint, text string, lang string"), model).count() == 0
    assert label_cases(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0


def test_other_scripts(spark, model):
    russian = "Пожалуйста, подтвердите дату поставки этого заказа как можно скорее."
    r = found(spark, model, [(1, russian, "ru"), (2, f"{EN} {russian} {russian}\n{EN}", "en"), (3, f"{EN} Ω and Привет.", "en")])
    assert [(x.doc_id, x.segment_no, x.lang) for x in r] == [(1, 0, "und"), (2, 0, "en"), (2, 1, "und"), (2, 2, "en"), (3, 0, "en")]
