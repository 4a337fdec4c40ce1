"""Token ids of whole texts by a public byte-level vocabulary.

Texts up to ``leaf_chars`` are encoded as they are. A longer one is cut into leaves that are
encoded in parallel; neighbours are then joined pairwise up a tree. At each join a window of
tokens around the seam is encoded again and grown until its ends repeat the tokens that both
sides already have, so the joined ids are those of the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how the vocabulary's makers split text before merging bytes.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LEAF_CHARS = 8_192
#: Tokens on each side of a seam that are encoded again at first, and those that must agree.
WINDOW, AGREE = 32, 4

_encoders: dict[int, Encoder] = {}


class Encoder:
    """Vocabulary with the byte length of each token."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=table, special_tokens={})
        self.length = np.zeros(max(table.values()) + 1, dtype=np.int64)
        for token, rank in table.items():
            self.length[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def batch(self, texts: list[str]) -> list[list[int]]:
        return self.encoding.encode_ordinary_batch(texts, num_threads=1)

    def join(self, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray], window: int = WINDOW) -> tuple[bytes, np.ndarray]:
        """Ids of the concatenation of two texts whose ids are known."""
        (lt, li), (rt, ri) = left, right
        if not lt or not rt:
            return (rt, ri) if not lt else (lt, li)
        ends_l, ends_r = np.cumsum(self.length[li]), np.cumsum(self.length[ri])
        while True:
            i, j = max(0, len(li) - window), min(len(ri), window)
            while i > 0 and _inside(lt, int(ends_l[i - 1])):
                i -= 1
            while j < len(ri) and _inside(rt, int(ends_r[j - 1])):
                j += 1
            start, stop = int(ends_l[i - 1]) if i else 0, int(ends_r[j - 1])
            middle = np.array(self.encode((lt[start:] + rt[:stop]).decode("utf-8")), dtype=np.int64)
            enough = len(middle) >= 2 * AGREE
            head = i == 0 or (enough and np.array_equal(middle[:AGREE], li[i : i + AGREE]))
            tail = j == len(ri) or (enough and np.array_equal(middle[-AGREE:], ri[j - AGREE : j]))
            if head and tail:
                return lt + rt, np.concatenate([li[:i], middle, ri[j:]])
            window *= 2

    def tree(self, leaves: list[str], ids: list[np.ndarray]) -> np.ndarray:
        level = [(t.encode("utf-8"), np.asarray(i, dtype=np.int64)) for t, i in zip(leaves, ids, strict=True)]
        while len(level) > 1:
            level = [self.join(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0][1]


def _inside(text: bytes, at: int) -> bool:
    """Whether a byte offset lies within a character."""
    return at < len(text) and text[at] & 0xC0 == 0x80


def encoder(ranks: Broadcast) -> Encoder:
    """One encoder per Python worker."""
    if ranks.value is None:
        raise ValueError("no vocabulary")
    key = hash(ranks.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks.value)
    return _encoders[key]


def share_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The vocabulary file (under 1 MB, fixed) for the executors, which need no copy of their own."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def leaves_of(text: Column, leaf_chars: int = LEAF_CHARS) -> Column:
    """Consecutive pieces of at most leaf_chars characters."""
    count = F.ceil(F.length(text) / leaf_chars).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(text, k * leaf_chars + 1, F.lit(leaf_chars)))


def encode_texts(docs: DataFrame, vocabulary: Broadcast, text: str = "text", keep: tuple[str, ...] = ("doc_id",), leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``keep`` and ``ids`` (array<int>) of every row: NULL and empty texts have an empty list.

    Strings of special tokens are ordinary text. Rows that repeat, also with one id, stay apart.
    Only ``keep`` and ``text`` are read, so other columns may have any name.
    """
    rows = docs.select(*keep, F.col(text).alias("_text"))
    size = F.length(F.coalesce("_text", F.lit("")))

    @F.pandas_udf("array<int>")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for texts in batches:
            yield pd.Series([np.asarray(x, dtype=np.int32) for x in enc.batch(texts.fillna("").tolist())], dtype=object)

    short = rows.where(size <= leaf_chars).select(*keep, whole("_text").alias("ids"))
    numbered = rows.where(size > leaf_chars).withColumn("_row", F.monotonically_increasing_id())
    pieces = numbered.select(*keep, "_row", F.posexplode(leaves_of(F.col("_text"), leaf_chars)).alias("_leaf", "_text"))
    encoded = pieces.repartition("_row", "_leaf").withColumn("ids", whole("_text"))
    schema = encoded.select(*keep, "ids").schema

    def join_leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_leaf")
        ids = encoder(vocabulary).tree(pdf["_text"].tolist(), pdf["ids"].tolist())
        out = pdf.iloc[:1][list(keep)].copy()
        out["ids"] = [ids.astype(np.int32)]
        return out

    return short.unionByName(encoded.groupBy("_row").applyInPandas(join_leaves, schema))
