import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderloom.llm.encode import encode_texts, share_vocabulary
from orderloom.llm.packing import Limits, fill_report, pack, pack_documents, token_counts

LIMITS = np.array([100.0, 5.0, 80.0])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.integers(0, 80)), max_size=60))
def test_limits_hold_and_room_is_used(items):
    d = np.array([(t, 1, min(loss, t)) for t, loss in items], dtype=float).reshape(-1, 3)
    bins = pack(d, LIMITS)
    assert len(bins) == len(d) and (bins >= 0).all()
    totals = [d[bins == k].sum(axis=0) for k in range(int(bins.max()) + 1)] if len(d) else []
    assert all((t <= LIMITS).all() and t[0] > 0 for t in totals)
    # no two containers could be one: first containers took all that fitted
    for i, a in enumerate(totals):
        assert not any(((a + d[bins == j]) <= LIMITS).all(axis=1).any() for j in range(i + 1, len(totals)))


def test_oversize_stands_alone():
    assert sorted(pack(np.array([[10.0, 1, 90], [10.0, 1, 1], [500.0, 1, 1]]), LIMITS)) == [0, 1, 2]


def test_documents(spark):
    words = "alpha beta gamma "
    rows = [(k, words * (k % 40 + 1)) for k in range(300)] + [(1000, None), (1001, ""), (1002, "Prompt line\n" + words * 2_000), (1003, words), (1003, words)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("shard", "n_tokens", "piece_no", "ids", "prompt", "c")})
    vocabulary = share_vocabulary(spark)
    limits = Limits(tokens=512, segments=8, loss=512)
    out = pack_documents(docs, vocabulary, limits, shard=100).toPandas()
    ids = encode_texts(docs, vocabulary).toPandas()
    sizes = ids.assign(n=ids["ids"].map(len)).groupby("doc_id")["n"].sum()
    assert (out.groupby("doc_id")["n_tokens"].sum() == sizes).all()
    used = out[out["n_tokens"] > 0]
    assert used["container_id"].notna().all() and out.loc[out["n_tokens"] == 0, "container_id"].isna().all()
    per = used.groupby("container_id").agg(n=("n_tokens", "sum"), k=("doc_id", "size"), loss=("n_loss", "sum"))
    assert per["n"].max() <= 512 and per["k"].max() <= 8 and per["loss"].max() <= 512
    cut = out[out["piece_no"] > 0]["doc_id"].unique()
    assert set(cut) == set(sizes[sizes > 512].index) - {1003}
    pieces = out[out["doc_id"] == 1002].sort_values("piece_no")
    assert (pieces["token_start"] == np.arange(len(pieces)) * 512).all() and (pieces["n_tokens"].iloc[:-1] == 512).all()


def test_loss_counts(spark):
    docs = spark.createDataFrame([(1, "Question here\nanswer text"), (2, "only answer"), (3, None), (4, "\nall")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_tokens, r.n_loss) for r in token_counts(docs, share_vocabulary(spark)).collect()}
    assert got[1][0] == got[1][1] + 3 and got[2][0] == got[2][1] and got[3] == (0, 0) and got[4][1] == got[4][0] - 1


def test_each_limit_binds_on_the_tables(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    out = pack_documents(docs, share_vocabulary(spark)).cache()
    fill = {r.dimension: r for r in fill_report(out).collect()}
    assert all(r.full > 0 for r in fill.values())
    # within 3 % of what no packing can go below, at a fixed capacity
    assert max(r.least_containers for r in fill.values()) / fill["tokens"].containers > 0.97
    assert out.agg(F.sum("n_tokens")).first()[0] == fill["tokens"].used
    empty = pack_documents(docs.limit(0), share_vocabulary(spark))
    assert empty.count() == 0 and [r.fill for r in fill_report(empty).collect()] == [None] * 3


def test_limits_steer_the_choice():
    # prompts beside answers: tokens bind; answers alone: loss binds; tiny ones: segments bind
    for d, limit in (([(50, 1, 0), (50, 1, 50)] * 6, 0), ([(50, 1, 50)] * 6, 2), ([(2, 1, 0)] * 12, 1)):
        d = np.array(d, dtype=float)
        bins = pack(d, LIMITS)
        totals = np.stack([d[bins == k].sum(axis=0) for k in range(bins.max() + 1)])
        assert np.ceil(d.sum(axis=0) / LIMITS)[limit] <= len(totals)
        assert (totals + d[0] > LIMITS)[:-1, limit].all()


def test_same_rows_whatever_the_tasks(spark):
    rows = [(None, "alpha beta")] * 50 + [(k, "word " * (k % 90 + 1)) for k in range(400)] + [(k, "word " * (k % 90 + 1)) for k in range(0, 400, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    vocabulary = share_vocabulary(spark)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    limits = Limits(tokens=256, segments=8, loss=240)
    first = key(pack_documents(docs, vocabulary, limits, shard=120))
    assert len(first) == len(rows)
    assert key(pack_documents(docs.repartition(7, "text"), vocabulary, limits, shard=120)) == first
    assert key(pack_documents(docs.orderBy(F.desc("text")).coalesce(1), vocabulary, limits, shard=120)) == first
