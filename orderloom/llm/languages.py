"""Languages of documents and of their segments, by multilingual mixture inference.

Sentences get likelihoods under character n-gram models. Expectation-maximisation estimates the
proportions in which a document mixes languages; languages are added one by one while they raise
the likelihood by more than a penalty. Each sentence takes its most likely language of the chosen
set, and runs of one language are segments.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notations of language labels, folded: code, longer codes, names in several languages.
LABEL_LINES = """
en eng english englisch anglais inglés ingles inglês inglese engels angielski
de deu ger german deutsch allemand alemán aleman alemão alemao tedesco duits niemiecki
fr fra fre french französisch franzosisch français francais francés frances francês francese frans francuski
es spa spanish spanisch espagnol español espanol espanhol spagnolo spaans hiszpański hiszpanski castellano castilian
pt por portuguese portugiesisch portugais portugués portugues português portoghese portugees portugalski
it ita italian italienisch italien italiano italiaans włoski wloski
nl nld dut dutch niederländisch niederlandisch néerlandais neerlandais neerlandés neerlandes holandés holandes holandês olandese nederlands niderlandzki holenderski flemish
pl pol polish polnisch polonais polaco polonês polones polacco pools polski
"""
LABELS = {word: line.split()[0] for line in LABEL_LINES.strip().splitlines() for word in line.split()}
LANGUAGES = tuple(line.split()[0] for line in LABEL_LINES.strip().splitlines())
#: Code of text in a script for which no language has a model.
OTHER = "und"
NAMES = (*LANGUAGES, OTHER)

#: Labelled documents of each language that the models are fitted on, and those of fewest letters among them.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 400, 150
#: Sentences of each of them that the models are fitted on (those of least hash, so that no long text outweighs
#: the others), and letters of the longest of these: what the driver gets is bounded by the three numbers.
SAMPLE_SENTENCES, SAMPLE_SENTENCE_CHARS = 40, 600
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: n-grams overlap, so log likelihoods count by this factor; a further language must gain more than PENALTY.
TEMPER, PENALTY = 0.3, 9.0
ROUNDS = 3

#: Between sentences: white space after an end sign, perhaps with a slash or dash in it.
BREAK = re.compile(r"(?<=[.!?…])[\s\u200b]+(?:(?:[/|–—-]+|//)\s+)?(?=[^\W\d_]|['\"¿¡«„])|\s+//?\s+(?=[^\W\d_]{2})")
LETTER, FOREIGN = re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_A-Za-zªºÀ-ɏḀ-ỿ]")
WORD = re.compile(r"[^\W\d_]{2,}")


def label_of(label: str | None) -> str | None:
    """Two-letter code that a label names (code, locale or name), None if it says nothing known."""
    low = (label or "").strip().lower()
    return LABELS.get(low) or LABELS.get(re.split(r"[-_ .(/]", low)[0])


def sentences(text: str | None) -> list[str]:
    """Sentences in reading order: pieces of at least four words that end like one, or seven that just stop.

    Headings, greetings, goods lines, codes and rows of numbers are none.
    """
    out = []
    for line in (text or "").splitlines():
        if not line or ("\t" in line or " | " in line) and len(WORD.findall(line)) < 5:
            continue
        for piece in BREAK.split(line.strip()):
            words = len(WORD.findall(piece))
            if words >= 4 and piece[-1] in ".!?…" or words >= 7 and piece[-1] not in ",:":
                out.append(piece)
    return out


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, letters only with blanks between words, and where each text starts."""
    cleaned = [f"  {' '.join(WORD.findall(t.lower()))}  " for t in texts]
    starts = np.cumsum([0, *(len(c) for c in cleaned)])
    codes = np.frombuffer("".join(cleaned).encode("utf-32-le"), dtype=np.uint32)
    return codes, starts


def _ngrams(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position."""
    h = np.full(len(codes) - order + 1, order * 7919, dtype=np.uint32)
    for i in range(order):
        h = h * np.uint32(1_000_003) ^ codes[i : len(codes) - order + 1 + i]
    return (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)


class Model:
    """Log probabilities of hashed n-grams by language."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def fit(cls, texts: list[str], langs: np.ndarray) -> Model:
        counts = np.zeros((len(LANGUAGES), len(ORDERS), BUCKETS), dtype=np.float32)
        for k in range(len(LANGUAGES)):
            own = [t for t, lang in zip(texts, langs, strict=True) if lang == k]
            if own:
                # texts without marks occur too
                plain = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in own]
                digraphs = [t.translate({228: "ae", 246: "oe", 252: "ue", 223: "ss"}) for t in own]
                codes, _ = _letters([*own, *own, *plain, *digraphs])
                for o, order in enumerate(ORDERS):
                    counts[k, o] = np.bincount(_ngrams(codes, order), minlength=BUCKETS)
        smoothed = counts + 0.05
        logs = np.log(smoothed / smoothed.sum(axis=2, keepdims=True))
        return cls(np.ascontiguousarray(logs.transpose(1, 2, 0)).astype(np.float32))

    def score(self, texts: list[str]) -> np.ndarray:
        """Tempered log likelihoods, one row a text, one column a language."""
        out = np.zeros((len(texts), len(LANGUAGES)), dtype=np.float64)
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (size < 400_000 or last == first):
                size += len(texts[last])
                last += 1
            codes, starts = _letters(texts[first:last])
            for o, order in enumerate(ORDERS):
                grams = self.table[o][_ngrams(codes, order)]
                out[first:last] += np.add.reduceat(grams, starts[:-1], axis=0)
            first = last
        return out * TEMPER


def with_other(ll: np.ndarray, texts: list[str]) -> np.ndarray:
    """Likelihoods with a column for no known language, which sentences take whose letters are mostly of another script."""
    foreign = np.array([not t.isascii() and 2 * len(FOREIGN.findall(t)) > len(LETTER.findall(t)) for t in texts], dtype=bool)
    other = np.where(foreign, ll.max(axis=1, initial=-1e9) + 10 * PENALTY, -1e6)
    return np.column_stack([ll, other])


def mixture(ll: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Chosen languages (column numbers) and the responsibilities of each sentence (rows) for them."""
    best = int(ll.sum(axis=0).argmax())
    chosen, total = [best], float(ll[:, best].sum())
    resp = np.ones((len(ll), 1))
    while len(chosen) < ll.shape[1]:
        # what a further language could gain at most says which to try first
        gains = np.maximum(ll - ll[:, chosen].max(axis=1, keepdims=True), 0).sum(axis=0)
        gains[chosen] = 0
        candidate = int(gains.argmax())
        if gains[candidate] <= PENALTY:
            break
        trial = [*chosen, candidate]
        part = ll[:, trial]
        peak = part.max(axis=1, keepdims=True)
        weights = np.exp(part - peak)
        share = np.full(len(trial), 1 / len(trial))
        for _ in range(rounds):
            joint = weights * share
            r = joint / joint.sum(axis=1, keepdims=True)
            new = r.mean(axis=0)
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        value = float((np.log((weights * share).sum(axis=1)) + peak[:, 0]).sum())
        if value - total <= PENALTY:
            break
        chosen, total, resp = trial, value, r
    return np.array(chosen), resp


def document_segments(ll: np.ndarray) -> list[tuple[str, float, int]]:
    """(language, confidence, sentences) of each segment of one document, in reading order."""
    chosen, resp = mixture(ll)
    picks = resp.argmax(axis=1)
    shifted = np.exp(ll - ll.max(axis=1, keepdims=True))
    certain = (shifted / shifted.sum(axis=1, keepdims=True))[np.arange(len(ll)), chosen[picks]]
    cuts = [0, *(np.flatnonzero(np.diff(picks)) + 1).tolist(), len(picks)]
    return [(NAMES[chosen[picks[a]]], float(np.mean(certain[a:b])), b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def batch_segments(ll: np.ndarray, sizes: np.ndarray) -> list[list[tuple[str | None, float, int]]]:
    """Segments of many documents, whose sentences (rows) follow one another; a document without sentences has one of no language.

    Where no second language could gain the penalty even if it took all sentences that it fits
    better, the mixture is of one language: most documents are told so at once, the others one by one.
    """
    out: list[list[tuple[str | None, float, int]]] = [[(None, 0.0, 0)]] * len(sizes)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    starts = np.cumsum(sizes[some]) - sizes[some]
    best = np.add.reduceat(ll, starts, axis=0).argmax(axis=1)
    of = np.repeat(np.arange(len(some)), sizes[some])
    own = ll[np.arange(len(ll)), best[of]]
    gains = np.add.reduceat(np.maximum(ll - own[:, None], 0), starts, axis=0)
    single = gains.max(axis=1) <= PENALTY
    peak = ll.max(axis=1)
    certain = np.add.reduceat(np.exp(own - peak) / np.exp(ll - peak[:, None]).sum(axis=1), starts) / sizes[some]
    for k, d in enumerate(some.tolist()):
        a, n = int(starts[k]), int(sizes[d])
        out[d] = [(NAMES[best[k]], float(certain[k]), n)] if single[k] else document_segments(ll[a : a + n])
    return out


def label_code(label: Column) -> Column:
    """Two-letter code that a label column names, else NULL."""
    low = F.lower(F.trim(label))
    table = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.split(low, r"[-_ .(/]")[0]))


def sampled_sentences(text: str) -> list[str]:
    """The sentences of a document that count in the fit, in reading order."""
    usable = [(xxhash.xxh64_intdigest(x), i, x) for i, x in enumerate(sentences(text)) if len(x) <= SAMPLE_SENTENCE_CHARS]
    return [x for _, _, x in sorted(sorted(usable)[:SAMPLE_SENTENCES], key=lambda t: t[1])]


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """code and sentences of at most ``per_language`` labelled documents of each language, those of least hash: the same at each run.

    The labels alone are counted first; then one scan of the texts looks only at hashes below the
    bound under which about twice as many documents of a language are.
    """
    space = 1 << 40
    coded = docs.select(label_code(F.col("lang")).alias("code"), "doc_id", "text").where("code is not null")
    counts = {r["code"]: r["n"] for r in coded.groupBy("code").agg(F.count("*").alias("n")).collect()}
    bounds = {code: min(space, space * 3 * per_language // n + 1) for code, n in counts.items()}
    rank = F.pmod(F.xxhash64("doc_id", "text"), F.lit(space))
    bound = F.coalesce(*(F.when(F.col("code") == code, F.lit(b)) for code, b in bounds.items()), F.lit(0))

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([sampled_sentences(t) for t in texts], dtype=object)

    low = coded.select("code", "text", rank.alias("rank"), bound.alias("bound")).where((F.col("rank") < F.col("bound")) & (F.length("text") >= SAMPLE_CHARS))
    small = low.select("code", "rank", F.xxhash64("text").alias("hash"), cut("text").alias("sentences"))
    # bounded by now: the least of each language, equal ones once
    best = F.slice(F.array_sort(F.collect_set(F.struct("rank", "hash", "sentences"))), 1, per_language)
    return small.groupBy("code").agg(best.alias("s")).select("code", F.explode("s").alias("s")).select("code", "s.sentences")


def fit_model(sample: list[tuple[str, list[str]]]) -> Model:
    """Models from the sentences of labelled texts of which a minority may be labelled wrongly or mixed.

    After each fit every sentence takes the language that it is likeliest in and the models are
    fitted again; labels only start the process.
    """
    texts = [x for code, own in sorted(sample) for x in own]
    labels = np.array([LANGUAGES.index(code) for code, own in sorted(sample) for _ in own], dtype=np.int64)
    model = Model.fit(texts, labels)
    for _ in range(ROUNDS):
        if texts:
            labels = model.score(texts).argmax(axis=1)
            model = Model.fit(texts, labels)
    return model


def language_segments(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, label, segment_no, lang, confidence, n_segments of every document.

    A document without a sentence (NULL, empty, blank, only codes or headings) has one row with lang
    NULL, segment 0 and confidence 0. Sentences in a script without any model are ``und``; a language in
    Latin letters without a model takes the likeliest one that has. Texts are read whole, whatever their length. Rows that repeat
    stay apart. Labels pass as they stand.
    """
    if model is None:
        sample = [(r["code"], list(r["sentences"])) for r in training_sample(docs).collect()]
        model = fit_model(sample)
    shared = docs.sparkSession.sparkContext.broadcast(model.table)

    @F.pandas_udf("array<struct<lang:string,confidence:double,n_sentences:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(shared.value)
        for texts in batches:
            parts = [sentences(t) if isinstance(t, str) else [] for t in texts]
            every = [s for p in parts for s in p]
            found = batch_segments(with_other(own.score(every), every), np.array([len(p) for p in parts], dtype=np.int64))
            rows = [[{"lang": a, "confidence": b, "n_sentences": c} for a, b, c in segments] for segments in found]
            yield pd.Series(rows, dtype=object)

    # else the explosion has a filter on the segments pushed below it, and each text is read twice
    found = docs.select("doc_id", F.col("lang").alias("label"), run.asNondeterministic()("text").alias("s"))
    return found.select("doc_id", "label", F.size("s").alias("n_segments"), F.posexplode("s").alias("segment_no", "g")).select(
        "doc_id", "label", "n_segments", "segment_no", "g.lang", "g.confidence", "g.n_sentences"
    )


def label_cases(docs: DataFrame) -> DataFrame:
    """Segments of documents whose label is missing or wrong or that mix languages; segments of no known language have no row."""
    found = language_segments(docs).where("lang is not null")
    named = label_code(F.col("label"))
    wrong = named.isNull() | (named != F.col("lang")) | (F.col("n_segments") > 1)
    return found.where(wrong & (F.col("lang") != OTHER)).select("doc_id", F.col("segment_no").cast("int"), "lang")
