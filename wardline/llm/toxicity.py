"""Toxic documents and the sentences that make them so: multiple-instance learning.

Labels speak about documents, but a few sentences make a document toxic. Each sentence gets
a probability from its words; a document is toxic if at least one sentence is (noisy-or).
The weights of the words are fitted to the labels of documents only, through the noisy-or,
and then tell which sentences offend.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import crc_held_out, hash_share

# A sentence ends at these signs; one that runs on is cut after a word.
SENTENCE = re.compile(r"[^.!?\n。！？]{1,1000}(?!\w)|[^.!?\n。！？]{1,1000}")
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)


@dataclass(frozen=True)
class Settings:
    """``toxic_docs`` and ``clean_docs`` bound the fit: so many distinct labelled texts at most.

    Of a text longer than ``train_chars`` one passage of that length is learned from.
    ``background`` is the log-odds of a sentence without any known word.
    """

    toxic_docs: int = 1500
    clean_docs: int = 3000
    train_chars: int = 8000
    least_docs: int = 4
    least_association: float = 15.0
    background: float = -5.0
    updates: int = 200
    rate: float = 0.2
    sparsity: float = 5e-4
    offending: float = 0.5
    remembered_words: int = 200_000


@dataclass(frozen=True)
class Model:
    """Weights of words (``=word``) and of their beginnings."""

    weights: dict[str, float]
    background: float


def word_features(word: str) -> list[str]:
    """A word counts as itself and by its beginnings, so that inflected and compound forms are known, too."""
    low = word.lower()
    return [f"={low}", *(low[:n] for n in BEGINNINGS if len(low) >= n)]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Start and end (code points, end exclusive) of the sentences that have a letter."""
    for found in SENTENCE.finditer(text):
        if WORD.search(text, *found.span()):
            yield found.span()


# ---------------------------------------------------------------- training


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def loss_and_slope(z: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of document labels under the noisy-or, and its slope for each sentence's log-odds.

    ``owner`` numbers the document of each sentence. With p for a sentence and P for its
    document the slope is p where the label is 0 and -p (1 - P) / P where it is 1.
    """
    p = _sigmoid(z)
    spared = np.bincount(owner, -np.logaddexp(0, np.clip(z, -30, 30)), minlength=len(toxic))  # log of 1 - P
    held = np.maximum(-np.expm1(spared), 1e-12)
    loss = -np.where(toxic == 1, np.log(held), spared).sum()
    return float(loss), p * np.where(toxic == 1, -np.exp(spared) / held, 1.0)[owner]


def association(with_feature: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Chi-square of each feature with the label, Yates' correction included.

    ``with_feature`` has a row of (clean, toxic) documents for each feature, ``docs`` the totals.
    """
    a, b = with_feature[:, 1].astype(float), with_feature[:, 0].astype(float)
    c, d = docs[1] - a, docs[0] - b
    total = docs.sum()
    gap = np.maximum(0, np.abs(a * d - b * c) - total / 2)
    return total * gap**2 / np.maximum(1, (a + b) * (c + d) * docs[1] * docs[0])


def train(samples: list[tuple[str, int]], settings: Settings = Settings()) -> Model:
    """Weights from (text, label) samples; the same samples, in any order, give the same weights.

    Only features that go with the label (``least_association``) get a weight: a rare word
    of a toxic document's harmless sentences would else be learned by heart.
    """
    samples = sorted(samples)
    toxic = np.array([label for _, label in samples], np.int64)
    number: dict[str, int] = {}
    ids, sizes, lengths = array("i"), array("i"), array("i")  # of all sentences: features, how many; sentences of each text
    counted = array("i"), array("i")  # features of each clean, of each toxic text, every feature once a text
    for text, label in samples:
        before, first = len(sizes), len(ids)
        for span in sentences(text):
            start = len(ids)
            for word in WORD.findall(text, *span):
                ids.extend([number.setdefault(f, len(number)) for f in word_features(word)])
            sizes.append(len(ids) - start)
        lengths.append(len(sizes) - before)
        counted[label].extend(set(ids[first:]))
    ids, sizes, lengths = (np.array(a, np.int32) for a in (ids, sizes, lengths))
    counts = np.stack([np.bincount(np.array(c, np.int32), minlength=len(number)) for c in counted], axis=1)
    useful = (counts.sum(axis=1) >= settings.least_docs) & (
        association(counts, np.bincount(toxic, minlength=2)) >= settings.least_association
    )
    place = np.cumsum(useful) - 1
    names = [f for f, i in number.items() if useful[i]]
    if not names:
        return Model({}, settings.background)
    keep = useful[ids]
    sentence_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    ids, sentence_of = place[ids[keep]], sentence_of[keep]
    # sentences without a useful feature are all alike; the background stands for them
    owner = np.repeat(np.arange(len(samples)), lengths)
    weigh = (len(toxic) / (2 * np.maximum(1, np.bincount(toxic, minlength=2))))[toxic] / len(toxic)
    weights, slope, square = (np.zeros(len(names)) for _ in range(3))
    for step in range(1, settings.updates + 1):
        z = settings.background + np.bincount(sentence_of, weights[ids], minlength=len(owner))
        dz = loss_and_slope(z, owner, toxic)[1] * weigh[owner]
        gradient = np.bincount(ids, dz[sentence_of], minlength=len(names))
        slope += 0.1 * (gradient - slope)
        square += 0.01 * (gradient**2 - square)
        rate = settings.rate * (1 - 0.9 * step / settings.updates)
        scale = np.sqrt(square / (1 - 0.99**step)) + 1e-4
        weights -= rate * (slope / (1 - 0.9**step)) / scale
        weights = np.sign(weights) * np.maximum(0, np.abs(weights) - rate * settings.sparsity / scale)
    return Model({n: float(w) for n, w in zip(names, weights, strict=True) if abs(w) > 0.01}, settings.background)


# ---------------------------------------------------------------- scoring


class Reader:
    """Scores texts with a model, remembering words it has met; what it remembers is bounded."""

    longest = 40

    def __init__(self, model: Model, settings: Settings = Settings()):
        self.model, self.settings = model, settings
        self.known: dict[str, float] = {}
        self.leak = float(np.logaddexp(0, model.background))

    def weight(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            found = sum(self.model.weights.get(f, 0.0) for f in word_features(word))
            if len(word) <= self.longest:
                if len(self.known) >= self.settings.remembered_words:
                    self.known.clear()
                self.known[word] = found
        return found

    def read(self, text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
        """Score, number of sentences and the offending sentences of a text.

        A sentence's share is what its words add to the background: without it a text
        would seem toxic for its length alone.
        """
        spared, count, found = 0.0, 0, []
        for start, end in sentences(text):
            count += 1
            evidence = 0.0
            for word in WORD.findall(text, start, end):
                evidence += self.weight(word)
            if evidence > 0:
                share = float(np.logaddexp(0, min(30.0, self.model.background + evidence))) - self.leak
                spared -= share
                own = -float(np.expm1(-share))
                if own >= self.settings.offending:
                    found.append((start, end, own))
        return -float(np.expm1(spared)), count, found


RESULT = "score double, n_sentences long, offending array<struct<start: int, `end`: int, score: double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _scorer(model: Model, settings: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, settings)
        for batch in batches:
            read = [reader.read(text.as_py() or "") for text in batch.column(1)]
            spans = [[{"start": s, "end": e, "score": p} for s, e, p in found] for _, _, found in read]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in read], pa.float64()),
                    pa.array([r[1] for r in read], pa.int64()),
                    pa.array(spans, _SPANS),
                ],
                ["doc_id", "score", "n_sentences", "offending"],
            )

    return score


def labelled_texts(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> list[tuple[str, int]]:
    """At most ``toxic_docs`` and ``clean_docs`` distinct texts with their label.

    Texts are drawn by a hash of the text among the distinct ones, so a text that a third
    of all rows repeat is one of them. Hashes and numbers are shuffled, not texts; only
    the texts drawn are read again.
    """
    marked = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    texts = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .filter(F.col("text").rlike(r"\p{L}") & ~crc_held_out(F.col("doc_id")))
        .withColumn("text_key", F.xxhash64("text"))
    )
    distinct = (
        texts.select("doc_id", "text_key").join(marked, "doc_id").groupBy("text_key", "toxic").agg(F.min("doc_id").alias("doc_id"))
    )
    bounds = {1: settings.toxic_docs, 0: settings.clean_docs}
    found = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def least_hashes(label: int) -> DataFrame:
        """Of the texts with a label those of the least hashes; a few more than needed come to the sort."""
        n = bounds[label]
        share = F.lit((n + 6 * n**0.5) / max(1, found.get(label, 0)))
        return distinct.filter((F.col("toxic") == label) & hash_share(F.col("text_key"), share)).orderBy("text_key").limit(n)

    drawn = [least_hashes(label) for label in bounds]
    passage = F.when(F.length("text") <= settings.train_chars, F.col("text")).otherwise(
        F.substr(
            "text",
            (F.pmod(F.shiftrightunsigned("text_key", 8), F.length("text") - settings.train_chars) + 1).cast("int"),
            F.lit(settings.train_chars),
        )
    )
    rows = (
        texts.join(F.broadcast(drawn[0].union(drawn[1])), ["doc_id", "text_key"])
        .select("text_key", "toxic", passage.alias("text"))
        .groupBy("text_key", "toxic")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    return [(r["text"], r["toxic"]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    return train(labelled_texts(docs, labels, settings), settings)


def score_toxicity(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, score, n_sentences, offending) of every row; offsets count code points.

    ``offending`` lists the sentences whose own probability reaches ``settings.offending``.
    A null text is empty. Texts without a word the model knows score 0, as does everything
    with a model that learned nothing. Rows may repeat; only ``doc_id`` and ``text`` are
    read, whatever other columns there are. Whole texts are read sentence by sentence: a
    very long text, or one without any full stop, adds sentences only.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_scorer(model, settings), f"doc_id long, {RESULT}")


def op11_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Toxicity of every document, learned from the labels of those that are not held out.

    ``held_out`` is one document in five, by the checksum of its number; false where the
    number is null. Labels that are null, or neither 0 nor 1, teach nothing; a number
    labelled twice counts as toxic if either label says so. Without labels, and on empty
    tables, every score is 0. See :func:`score_toxicity` for texts.
    """
    model = fit(docs, labels, settings)
    return score_toxicity(docs, model, settings).select(
        "doc_id",
        crc_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
        "offending",
    )
