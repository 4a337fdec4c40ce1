"""Texts packed into containers of fixed capacity.

Vector bin packing by a dot-product heuristic, for instruction data: every container is limited in
tokens, in segments and in loss-bearing tokens at once. It is opened with the largest example left
and takes, again and again, the fitting example whose demands point most in the direction of the
room that is left, weighted by what the examples still left need; near its end the one that fills
most. Examples are spread over shards of bounded size that are packed independently; each shard
leaves at most a container or so unfilled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.encode import LEAF_CHARS, encode_texts, encoder
from orderloom.session import spread


@dataclass(frozen=True)
class Limits:
    """What one container holds at most. Each limit binds: the loss limit where answers prevail over
    prompts, the one on segments (attention masks of a training batch) where texts are short."""

    tokens: int = 2_048
    segments: int = 16
    loss: int = 1_900


#: Examples packed by one task.
SHARD = 4_000
#: Share of the room left in some dimension from which an example counts as one that ends the container.
ENDING = 0.8
#: Copies of one example that are told apart in one go; more take a second level.
COPIES = 4_096


def token_counts(docs: DataFrame, vocabulary: Broadcast, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, n_loss of every document; loss-bearing are the tokens after the first line, the prompt.

    A text of one line is all answer. NULL and empty texts have no tokens.
    """

    def counted(ids: np.ndarray, prompt: int) -> tuple[int, int]:
        ends = np.cumsum(encoder(vocabulary).length[np.asarray(ids, dtype=np.int64)])
        return len(ids), int((ends > prompt).sum())

    @F.pandas_udf("struct<n_tokens:int,n_loss:int>")
    def direct(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, prompts in batches:
            ids = encoder(vocabulary).batch(texts.fillna("").tolist())
            yield pd.DataFrame([counted(i, p) for i, p in zip(ids, prompts, strict=True)], columns=["n_tokens", "n_loss"])

    @F.pandas_udf("struct<n_tokens:int,n_loss:int>")
    def given(ids: pd.Series, prompts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counted(i, p) for i, p in zip(ids, prompts, strict=True)], columns=["n_tokens", "n_loss"])

    first_line = F.when(F.instr("text", "\n") > 0, F.octet_length(F.substring_index("text", "\n", 1)) + 1).otherwise(0)
    rows = docs.select("doc_id", "text", F.coalesce(first_line, F.lit(0)).alias("prompt"))
    long = F.length(F.coalesce("text", F.lit(""))) > leaf_chars
    short = rows.where(~long).select("doc_id", direct("text", "prompt").alias("c"))
    tall = encode_texts(rows.where(long), vocabulary, keep=("doc_id", "prompt"), leaf_chars=leaf_chars).select("doc_id", given("ids", "prompt").alias("c"))
    return short.unionByName(tall).select("doc_id", "c.n_tokens", "c.n_loss")


def pack(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each example (rows of demands, one column a limit): dot-product heuristic.

    An example that alone breaks a limit has a container to itself.
    """
    n = len(demands)
    container = np.full(n, -1, dtype=np.int64)
    d = demands / limits
    order = np.lexsort((np.arange(n), *(-d[:, k] for k in range(d.shape[1] - 1, -1, -1)), -d.max(axis=1)))
    d = d[order] * 1.0
    size = np.linalg.norm(d, axis=1)
    needed = d.sum(axis=0)
    left = np.arange(n)
    k = 0
    while len(left):
        # dimensions that the examples left need more of count for more
        weight = np.maximum(needed, 1e-12) / max(needed.sum(), 1e-12)
        room = np.ones(d.shape[1])
        taken: list[int] = []
        alive = left
        while len(alive):
            part = d[alive]
            fits = (part <= room + 1e-9).all(axis=1)
            alive, part = alive[fits], part[fits]
            if not len(alive):
                break
            pick = 0
            if taken:
                along = part @ (weight * room)
                ends = (part >= ENDING * room).any()
                pick = int((along if ends else along / size[alive]).argmax())
            item = alive[pick]
            taken.append(item)
            room = room - d[item]
            alive = np.delete(alive, pick)
        if not taken:
            taken = [left[0]]
        needed = needed - d[taken].sum(axis=0)
        container[order[taken]] = k
        left = np.setdiff1d(left, taken, assume_unique=True)
        k += 1
    return container


def pieces_of(counts: DataFrame, limits: Limits) -> DataFrame:
    """doc_id, piece_no, token_start, n_tokens, n_loss: only what has more tokens than a container is cut, into full pieces and a rest."""
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / limits.tokens).cast("int") - 1, F.lit(0))))
    pieces = counts.select("doc_id", "n_tokens", "n_loss", piece.alias("piece_no"))
    start = F.col("piece_no") * limits.tokens
    size = F.least(F.lit(limits.tokens), F.col("n_tokens") - start)
    # loss-bearing tokens are the last ones of the document
    loss = F.greatest(F.lit(0), F.least(size, start + size - (F.col("n_tokens") - F.col("n_loss"))))
    return pieces.select("doc_id", "piece_no", start.alias("token_start"), size.alias("n_tokens"), loss.cast("int").alias("n_loss"))


def pack_documents(docs: DataFrame, vocabulary: Broadcast, limits: Limits = Limits(), shard: int = SHARD) -> DataFrame:
    """doc_id, piece_no, token_start, n_tokens, n_loss, container_id: each token of each document exactly once.

    Only a document of more tokens than a container holds is cut, into full pieces and a rest; one
    that breaks the limit on loss-bearing tokens alone has a container to itself. A document without
    tokens takes no room: it has one row with container_id NULL. Documents that repeat are packed
    each; other columns are not read. The rows are the same at each run, however tables are split
    and tasks repeated: shards follow from the pieces' own values and the number among equal ones.
    """
    pieces = pieces_of(token_counts(docs, vocabulary), limits)
    names = pieces.columns
    shards = max(1, -(-docs.count() // shard))
    # equal pieces (a document that repeats, or none known by its id) are counted and told apart by number
    counted = pieces.groupBy(*names).agg(F.count("*").alias("copies"))
    blocks = counted.select(*names, "copies", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES))).alias("block"))
    last = F.least(F.col("copies") - F.col("block") * COPIES, F.lit(COPIES).cast("bigint")) - 1
    single = blocks.select(*names, "block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("copy"))
    spread_out = single.select(*names, F.pmod(F.xxhash64(*names, "block", "copy"), F.lit(shards)).cast("int").alias("shard"))
    caps = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "n_loss", "doc_id", "piece_no"], ascending=False, ignore_index=True)
        used = pdf["n_tokens"] > 0
        demands = np.column_stack([pdf.loc[used, "n_tokens"], np.ones(int(used.sum())), pdf.loc[used, "n_loss"]]).astype(np.float64)
        numbers = pd.Series(pd.NA, index=pdf.index, dtype="Int64")
        numbers[used] = pack(demands, caps) + (int(pdf["shard"].iloc[0]) << 32)
        return pdf.assign(container_id=numbers)[["doc_id", "piece_no", "token_start", "n_tokens", "n_loss", "container_id"]]

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece_no int, token_start int, n_tokens int, n_loss int, container_id bigint"
    # few bytes, much work: adaptive execution would put all shards into one task
    return spread(spread_out, "shard").groupBy("shard").applyInPandas(run, schema)


def fill_report(packed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """dimension, used, containers, fill (share of the capacity of all containers), least_containers, full: a row for each limit.

    least_containers is a bound that no packing can go below, full the number of containers that an
    average segment (or token) more in this dimension would break.
    """
    per = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("n_loss").alias("loss"))
    caps = {"tokens": limits.tokens, "segments": limits.segments, "loss": limits.loss}
    sums = per.agg(F.count("*").alias("containers"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in caps), *(F.count_if(F.col(c) >= 0.985 * cap).alias(f"full_{c}") for c, cap in caps.items()))
    row = lambda c, cap: F.struct(
        F.lit(c).alias("dimension"), F.col(c).alias("used"), F.col("containers"), F.try_divide(F.col(c), F.col("containers") * cap).alias("fill"),
        F.ceil(F.col(c) / cap).alias("least_containers"), F.col(f"full_{c}").alias("full"),
    )
    return sums.select(F.explode(F.array(*(row(c, cap) for c, cap in caps.items()))).alias("r")).select("r.*")
