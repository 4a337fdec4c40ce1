import json
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orderloom.llm.encode import VOCABULARY, Encoder, encode_texts, share_vocabulary

ENCODER = Encoder(Path(VOCABULARY).read_bytes())


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(str(Path(VOCABULARY).with_suffix(".json")))
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 's\n\tt1.,!éß漢🚚 don'tllve")), max_size=300) | st.text(max_size=200), st.integers(1, 60))
def test_tree_equals_whole(text, leaf):
    leaves = [text[i : i + leaf] for i in range(0, len(text), leaf)] or [""]
    assert ENCODER.tree(leaves, [np.array(ENCODER.encode(x), dtype=np.int64) for x in leaves]).tolist() == ENCODER.encode(text)


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 15_000, " " * 30_000, "é" * 20_000, "x1" * 9_000, "\n" * 9_000, "word " * 9_000, "don't" * 6_000])
def test_unsplit_runs(text):
    leaves = [text[i : i + 4096] for i in range(0, len(text), 4096)]
    assert ENCODER.tree(leaves, [np.array(ENCODER.encode(x)) for x in leaves]).tolist() == ENCODER.encode(text)


def test_same_ids_as_the_public_tokenizer(reference, data):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{data}/documents.parquet").column("text").to_pylist() if t]
    texts += ["<|endoftext|> x", "\u0000​", " \t\n ", "ﬁ Ǆ 🏳️‍🌈"]
    assert ENCODER.batch(texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_rows(spark):
    long = "The quick brown fox, " * 900
    rows = [(1, None), (2, ""), (3, "hello <|endoftext|>"), (4, long), (4, long), (5, "a" * 20_000), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("ids", "_row", "_leaf", "_text", "lang")})
    found = encode_texts(docs, share_vocabulary(spark))
    assert found.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r.doc_id, r.ids) for r in found.collect()) == sorted((k, ENCODER.encode(t or "")) for k, t in rows)
    assert encode_texts(docs.limit(0), share_vocabulary(spark)).count() == 0


def test_vocabulary_is_public():
    assert len(json.loads(Path(VOCABULARY).with_suffix(".json").read_text())["model"]["vocab"]) == len(ENCODER.length)
