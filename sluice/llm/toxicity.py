"""Toxicity by multiple-instance learning: a document is a bag of sentences, toxic if any sentence is.

A sentence's score is a logistic function of the sum of its distinct words' weights; a word's
weight is the sum over hashed features: the word, and its beginnings of three to seven letters,
so that inflected and compound forms share what is learnt. Sentence scores combine by noisy-or,
1 - prod(1 - p), and the weights are fitted to the documents' labels through that combination,
so sentences need no labels. The fitted sentence scores then locate the offending sentences.

Fitting takes a bounded, documented sample: at most ``max_rows`` labelled documents and
``max_bytes`` of text, half of each for either class, those of smallest hash. The L1 charge is
chosen on a quarter of the sample that the others are fitted without; then all of it is fitted.
Scoring takes every document and whole texts. Text is the only input of a score.

Null and empty texts have no sentence and score 0. Rows whose label or id is null teach
nothing. An id with several labels is toxic if one of them says so; an id with several texts
teaches by the one of smallest hash. Repeated rows score alike. With labels of one class only,
every text that is not empty scores that class's share (smoothed); without labels, and so for
an empty table of documents, nothing is learnt and all score 0. A score of exactly the limit offends.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._shared import free_name, save, tune

#: Hashed features, and the sample's bounds.
FEATURES, MAX_ROWS, MAX_BYTES = 1 << 18, 6000, 64 << 20
#: L1 charges to choose from, in documents, and rounds of a fit that only serves to choose.
CHARGES, TRIAL = (0.3, 1.0, 3.0), 50
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_WORD_OR_END = re.compile(r"[^\W\d_]+|[.!?\n]+")
#: Words whose weights are kept, and texts scored together.
_CACHE, TEXTS = 400_000, 200


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word."""
    forms = [f"={word}", *(f"^{word[:n]}" for n in range(3, 8) if len(word) > n)]
    return [zlib.crc32(x.encode()) % FEATURES for x in forms]


def bags(text: str) -> list[set[str]]:
    """The distinct words of each sentence that has any."""
    return [words for s in _SENTENCE.findall(text.lower()) if (words := set(_WORD.findall(s)))]


class Bags:
    """Documents as words of sentences of documents, and words as features."""

    def __init__(self, texts: list[str], toxic: list[int]):
        known: dict[str, int] = {}
        words, sentence_of, doc_of = [], [], []
        for doc, text in enumerate(texts):
            for bag in bags(text):
                words += [known.setdefault(w, len(known)) for w in sorted(bag)]
                sentence_of += [len(doc_of)] * len(bag)
                doc_of.append(doc)
        feats = [features(w) for w in known]
        self.y = np.array(toxic, np.float64)
        self.words, self.sentence_of, self.doc_of = (np.array(x, np.int64) for x in (words, sentence_of, doc_of))
        self.word_of = np.repeat(np.arange(len(feats)), [len(x) for x in feats])
        self.seen, self.feat = np.unique(np.array([x for f in feats for x in f], np.int64), return_inverse=True)
        self.known = len(known)

    def part(self, docs: np.ndarray) -> Bags:
        """The same for some documents (a mask), with the same words and features."""
        out = object.__new__(Bags)
        out.word_of, out.seen, out.feat, out.known = self.word_of, self.seen, self.feat, self.known
        sentences = docs[self.doc_of]
        held = sentences[self.sentence_of]
        out.words = self.words[held]
        out.sentence_of = (np.cumsum(sentences) - 1)[self.sentence_of[held]]
        out.doc_of, out.y = (np.cumsum(docs) - 1)[self.doc_of[sentences]], self.y[docs]
        return out

    def spread(self) -> np.ndarray:
        """In how many documents each feature occurs, counted by word."""
        pairs = np.unique(self.doc_of[self.sentence_of] * np.int64(self.known) + self.words)
        return np.bincount(self.feat, np.bincount(pairs % self.known, minlength=self.known)[self.word_of], len(self.seen))

    def loss(self, theta: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        """The noisy-or model's mean loss, and its gradient for the features' weights and the bias."""
        z = bias + np.bincount(self.sentence_of, np.bincount(self.word_of, theta[self.feat], self.known)[self.words], len(self.doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = np.maximum(np.bincount(self.doc_of, np.logaddexp(0, z), len(self.y)), 1e-9)  # minus the log of "no sentence is toxic"
        gone = np.exp(-total)
        loss = np.where(self.y == 1, -np.log1p(-gone), total).mean()
        pull = np.where(self.y == 1, -gone / (1 - gone), 1.0) / len(self.y)
        g = pull[self.doc_of] * p
        by_word = np.bincount(self.words, g[self.sentence_of], self.known)
        return float(loss), np.bincount(self.feat, by_word[self.word_of], len(self.seen)), float(g.sum())


def descend(bags: Bags, charge: float, rounds: int, rate: float = 0.25) -> tuple[np.ndarray, float]:
    """(weights of the features seen, bias) by Adam on the loss with an L1 charge.

    The charge, in documents, keeps every feature at zero that fewer documents' evidence would move.
    """
    # a feature of one document only can't be told from that document
    open_, toll = bags.spread() >= 3, charge / len(bags.y)
    theta, bias = np.zeros(len(bags.seen)), -4.0
    m, v, mb, vb = np.zeros(len(theta)), np.zeros(len(theta)), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, gt, gb = bags.loss(theta, bias)
        gt = gt * open_
        gt = np.where(theta != 0, gt + toll * np.sign(theta), np.sign(gt) * np.maximum(np.abs(gt) - toll, 0))
        m, v, mb, vb = 0.9 * m + 0.1 * gt, 0.99 * v + 0.01 * gt * gt, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * min(1.0, 4 * (1 - t / rounds) + 0.02)
        moved = theta - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta = np.where(moved * theta < 0, 0.0, moved) * (open_ & ((gt != 0) | (theta != 0)))
        bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return theta, float(bias)


def fit(texts: list[str], toxic: list[int], rounds: int = 120, charges: tuple[float, ...] = CHARGES) -> tuple[np.ndarray, float, float]:
    """(weights of all hashed features, bias, charge) of the noisy-or model over all given documents.

    The charge is the one of least loss on every fourth document after a fit without those (on a
    tie the larger). The smallest stands where a class has no document on either side of that split.
    """
    y = np.array(toxic, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    bags = Bags(texts, toxic)
    if not len(bags.words) or y.min() == y.max():
        return np.zeros(FEATURES, np.float32), float(np.log(share / (1 - share))), charges[0]
    away = np.zeros(len(y), bool)
    for c in (0, 1):
        away[np.flatnonzero(y == c)[3::4]] = True
    kept, tried = bags.part(~away), bags.part(away)
    charge = charges[0]
    if len(charges) > 1 and all(len(b.words) and b.y.min() != b.y.max() for b in (kept, tried)):
        charge = min(charges, key=lambda c: (tried.loss(*descend(kept, c, min(rounds, TRIAL)))[0], -c))
    theta, bias = descend(bags, charge, rounds)
    weights = np.zeros(FEATURES, np.float32)
    weights[bags.seen] = theta
    return weights, bias, charge


def _chosen(clean: DataFrame, most: int) -> DataFrame:
    """The rows (of, toxic, turn) of smallest ``turn``, a 60-bit hash: at most ``most`` of each class and, of a large class, nearly that."""
    counts = {r["toxic"]: r["n"] for r in clean.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    parts = []
    for label, n in sorted(counts.items()):
        own, cut = clean.where(F.col("toxic") == label), 1 << 60
        while n > most:  # a threshold for a little less than asked, lowered in the odd case that more lie below it
            cut = int(min(cut - 1, (1 << 60) * most / n) * 0.95)
            below = own.where(F.col("turn") < cut).count()
            if below <= most:
                break
            n = max(n, below) * 1.05
        parts.append(own.where(F.col("turn") < cut))
    return parts[0].unionByName(parts[-1]) if len(parts) == 2 else parts[0] if parts else clean


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    """Fit on the sample; ``labels`` holds (id, label) of the rows that may teach. One task fits, the weights come back."""
    tune(docs.sparkSession)
    clean = labels.select(F.col(f"`{id_col}`").alias("of"), F.col(f"`{label}`").cast("int").alias("toxic")).where("of is not null and toxic in (0, 1)").groupBy("of").agg(F.max("toxic").alias("toxic"))
    turn = F.conv(F.substring(F.md5(F.col("of").cast("string")), 1, 15), 16, 10).cast("long")
    clean = save(clean.withColumn("turn", turn), "toxicity-labels")
    chosen = _chosen(clean, max_rows // 2)  # at most max_rows rows
    body = F.col(f"`{text}`").cast("string")
    sample = docs.select(F.col(f"`{id_col}`").alias("of"), body.alias("text")).join(F.broadcast(chosen), "of")
    hashed = F.xxhash64("text")
    sizes = sample.groupBy("of").agg(F.max("toxic").alias("toxic"), F.max("turn").alias("turn"), F.min(F.struct(hashed.alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))).alias("first"))
    rows = sorted(sizes.select("toxic", "turn", "of", "first.h", "first.n").collect(), key=lambda r: (r["turn"], str(r["of"])))  # at most max_rows rows
    within, left = [], [max_bytes // 2] * 2
    for r in rows:
        if r["n"] <= left[r["toxic"]]:  # a text that would go beyond the bound is passed over
            left[r["toxic"]] -= r["n"]
            within.append((r["of"], r["h"]))
    if not within:
        return np.zeros(FEATURES, np.float32), -np.inf
    kept = docs.sparkSession.createDataFrame(within, f"of {docs.schema[id_col].dataType.simpleString()}, h long")
    sample = sample.withColumn("h", hashed).join(F.broadcast(kept), ["of", "h"]).groupBy("of", "toxic").agg(F.first("text").alias("text"))

    def run(batches):
        rows = sorted((str(of), toxic, text or "") for batch in batches for of, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(3))))
        if rows:
            weights, bias, _ = fit([x[2] for x in rows], [x[1] for x in rows])
            yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()]), pa.array([bias])], names=["weights", "bias"])

    row = sample.repartition(1).mapInArrow(run, "weights binary, bias double").first()  # max_bytes of text at most
    return (np.frombuffer(row["weights"], "<f4"), row["bias"]) if row else (np.zeros(FEATURES, np.float32), -np.inf)


class Scorer:
    """Scores texts by a fitted model; words' weights are kept in a bounded table."""

    def __init__(self, model: tuple[np.ndarray, float], offending: float):
        self.weights, self.bias = model
        self.flat = not np.any(self.weights)
        self.limit = np.log(offending / (1 - offending))
        self.known: dict[str, int] = {}
        self.word_weights = np.zeros(0)

    def _number(self, words: list[str]) -> None:
        """Give new words numbers and weights."""
        new = list(set(words).difference(self.known))
        if new:
            held = [features(w) for w in new]
            flat = self.weights[np.array([x for f in held for x in f], np.int64)].astype(np.float64)
            sums = np.add.reduceat(flat, np.cumsum([0, *(len(x) for x in held[:-1])]))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.word_weights = np.concatenate([self.word_weights, sums])

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
        """(scores, offending sentences) of texts, all sentences of all texts at once."""
        if self.flat:
            total = np.array([np.logaddexp(0.0, self.bias) if x else 0.0 for x in texts])
            return -np.expm1(-total), [[] for _ in texts]
        if len(self.known) > _CACHE:
            self.known, self.word_weights = {}, np.zeros(0)
        split = [_WORD_OR_END.findall(x.lower()) for x in texts]
        self._number([w for x in split for w in x if w[0] not in ".!?\n"])
        numbers = np.array([self.known.get(w, -1) for x in split for w in x], np.int64)  # -1: a sentence ends
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        sentence = np.cumsum(np.append(0, (numbers[:-1] < 0) | (doc[1:] != doc[:-1]))) if len(numbers) else numbers
        held = numbers >= 0
        pairs = np.unique(sentence[held] * np.int64(len(self.known) + 1) + numbers[held])  # distinct words of each sentence
        sentences, of = np.unique(pairs // (len(self.known) + 1), return_inverse=True)
        z = self.bias + np.bincount(of, self.word_weights[pairs % (len(self.known) + 1)], len(sentences))
        owner = doc[np.searchsorted(sentence, sentences)]
        scores = -np.expm1(-np.bincount(owner, np.logaddexp(0.0, z), len(texts)))
        spans: list[list[dict]] = [[] for _ in texts]
        for n in np.unique(owner[z >= self.limit]).tolist():
            own = z[owner == n].tolist()
            text = texts[n]
            places = [s.span() for s in _SENTENCE.finditer(text) if _WORD.search(s.group().lower())]
            spans[n] = [{"start": a, "end": b, "score": float(1 / (1 + np.exp(-min(x, 30))))} for (a, b), x in zip(places, own) if x >= self.limit]
        return scores, spans


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", offending: float = 0.5) -> DataFrame:
    """``docs`` without its text, with score and offending: the sentences at or above that score, as (start, end, score) in characters."""
    tune(docs.sparkSession)
    held = [c for c in docs.columns if c != text and c.lower() not in ("score", "offending")]
    body = free_name(docs, "body")
    rows = docs.select(*[F.col(f"`{c}`") for c in held], F.col(f"`{text}`").cast("string").alias(body))
    schema = rows.drop(body).schema
    for field in docs.sparkSession.createDataFrame([], "score double, offending array<struct<start: int, end: int, score: double>>").schema:
        schema = schema.add(field)

    def run(batches):
        scorer = Scorer(model, offending)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            texts = [x or "" for x in batch.column(len(held)).to_pylist()]
            for k in range(0, len(texts), TEXTS):
                scores, spans = scorer.score(texts[k : k + TEXTS])
                columns = [batch.column(i).slice(k, TEXTS) for i in range(len(held))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[*held, "score", "offending"])

    return rows.mapInArrow(run, schema)
