"""Language identification with a linear-chain conditional random field (operator 6).

Every word of a text gets a label. A word's emission score sums learned weights of its affixes, character n-grams and
lexicon entries; learned transition weights tie neighbouring labels; forward-backward gives each word's label
probabilities. A document's language is the one with the highest mean probability over its words, and that mean its score.

Documents carry one label each, so switching is learned from spliced sequences: stretches of documents in different
languages, joined. Training fits the weights on the driver, on a bounded sample of labelled rows; prediction runs over all
rows in Arrow batches, scoring each distinct word once per batch run.

All languages that occur as labels are learned. The model holds a weight for each feature of the sample and language, so its
size is bounded by the sample's features times the number of languages; what workers hold besides is bounded in values.

Edge cases: a null text, or one without a letter (a character of Unicode's L), is `und` with score 0; a null lang is no label;
without labelled rows every text is `und`; ties go to the language first by code point; a text of any length is labelled
whole: the chain runs in stretches of STRETCH words between which only messages are kept; repeated rows are labelled alike;
further columns of docs are kept by identified, whatever their names (but `__lid`, which is its own).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import few_rows, given_back, table

#: The bound of the training sample: so many rows in all, as many of each language (at least LEAST_ROWS of each, however many
#: languages there are), none of more bytes than this.
TRAIN_ROWS = 480
LEAST_ROWS = 4
TRAIN_ROW_BYTES = 20_000
BUCKETS = 1 << 16
LEXICON = 300
SEQUENCE = 48
STEPS = 40
SEED = 7
#: Emission values (words times languages) that a worker keeps; at more it starts anew.
MAX_VALUES = 1_000_000
#: Steps of a chain between which only the messages are kept.
STRETCH = 4096
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; what counts as alphanumeric but is no letter (such as fractions) parts them."""
    found = _WORD.findall(text.lower())
    if not found or "".join(found).isalpha():
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def _features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    """Hashed affixes (to 3 letters), n-grams (2 and 3, with ends marked), the word, and its lexicons."""
    marked = f"^{word}$"
    names = [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)]
    names += [marked[i : i + 2] for i in range(len(marked) - 1)] + [marked[i : i + 3] for i in range(len(marked) - 2)]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names] + [BUCKETS + k for k in lexicon.get(word, ())]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # features of the sample, and a row of zeros, x languages
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # row of each feature; the last where it was never seen
    lexicon: dict[str, list[int]] = field(default_factory=dict)
    transition: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pieces: frozenset[str] = frozenset()  # letter sequences of the sample's words, by which texts count as familiar

    def emissions(self, words: list[str]) -> np.ndarray:
        """Emission scores (words x languages)."""
        feats = [_features(w, self.lexicon) for w in words]
        starts = np.cumsum([0, *(len(f) for f in feats[:-1])])
        return np.add.reduceat(self.weights[self.place[np.fromiter((i for f in feats for i in f), np.int64)]], starts, axis=0)

    def familiar(self, word: str) -> float:
        """The share of a word's letter sequences that the sample has."""
        own = _pieces(word)
        return sum(p in self.pieces for p in own) / len(own)


def _pieces(word: str) -> list[str]:
    """Three letters at a time, with ends marked."""
    marked = f"^{word}$"
    return [marked[i : i + 3] for i in range(len(marked) - 2)]


def _posteriors(emission: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities and summed pair probabilities of sequences of equal length (n x t x k)."""
    n, t, k = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    s, a = np.exp(start - start.max()), np.exp(transition - transition.max())
    fwd, bwd = np.empty_like(e), np.ones_like(e)
    fwd[:, 0] = s * e[:, 0]
    fwd[:, 0] /= fwd[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        f = (fwd[:, i - 1] @ a) * e[:, i]
        fwd[:, i] = f / f.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        ahead = bwd[:, i + 1] * e[:, i + 1]
        b = ahead @ a.T
        scale = (fwd[:, i] * b).sum(axis=1, keepdims=True)
        pairs += a * (fwd[:, i] / scale).T.dot(ahead)
        bwd[:, i] = b / b.sum(axis=1, keepdims=True)
    post = fwd * bwd
    return post / post.sum(axis=2, keepdims=True), pairs


def fit(rows: list[tuple[str, str]], seed: int = SEED) -> Model:
    """A model from (text, language) rows; full-batch gradient steps with Adam on the conditional log-likelihood."""
    langs = sorted({lang for _, lang in rows})
    rng, k = np.random.default_rng(seed), len(langs)
    spans: list[tuple[list[str], int]] = []
    seen: list[Counter] = [Counter() for _ in langs]
    for text, lang in rows:
        words, y = words_of(text), langs.index(lang)
        seen[y].update(set(words))
        at = 0
        while at < len(words):
            n = int(rng.integers(4, 2 * SEQUENCE))
            spans.append((words[at : at + n], y))
            at += n
    if not spans:
        return Model(langs)
    order = rng.permutation(len(spans))
    flat = [w for i in order for w in spans[i][0]]
    labels = np.concatenate([np.full(len(spans[i][0]), spans[i][1]) for i in order])
    n = max(1, len(flat) // SEQUENCE)
    if len(flat) < SEQUENCE:
        flat, labels = flat * SEQUENCE, np.tile(labels, SEQUENCE)
    flat, labels = flat[: n * SEQUENCE], labels[: n * SEQUENCE].reshape(n, SEQUENCE)
    lexicon: dict[str, list[int]] = {}
    for y, counts in enumerate(seen):
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, []).append(y)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.array([vocabulary[w] for w in flat]).reshape(n, SEQUENCE)
    feats = [_features(w, lexicon) for w in vocabulary]
    sizes = np.array([len(f) for f in feats])
    starts, index = np.r_[0, np.cumsum(sizes)[:-1]], np.concatenate(feats)
    owner = np.repeat(np.arange(len(feats)), sizes)
    # Only features that occur are trained; the others keep weight 0.
    used, local = np.unique(index, return_inverse=True)
    flat_ids, hot = ids.ravel(), np.eye(k)[labels]
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    gold_start = np.bincount(labels[:, 0], minlength=k)
    params = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        w, a, s = params
        emission = np.add.reduceat(w[local], starts, axis=0)
        post, pairs = _posteriors(emission[ids], s, a)
        diff = (hot - post).reshape(-1, k)
        by_word = np.stack([np.bincount(flat_ids, diff[:, j], len(feats)) for j in range(k)], axis=1)
        by_feature = np.stack([np.bincount(local, by_word[owner, j], len(used)) for j in range(k)], axis=1)
        grads = [by_feature / n - 1e-4 * w, (gold_pairs - pairs) / n, (gold_start - post[:, 0].sum(axis=0)) / n]
        for i, g in enumerate(grads):
            means[i] = 0.9 * means[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            rate = 0.1 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            params[i] = params[i] + rate * means[i] / (np.sqrt(squares[i]) + 1e-8)
    place = np.full(BUCKETS + k, len(used), np.int32)
    place[used] = np.arange(len(used))
    pieces = frozenset(p for w in vocabulary for p in _pieces(w))
    return Model(langs, np.concatenate([params[0], np.zeros((1, k))]), place, lexicon, params[1], params[2], pieces)


class _Words(dict):
    """Numbers words as they come; emissions of new ones are added by scores()."""

    def __init__(self, model: Model, familiar: bool = True):
        super().__init__()
        self.asked = familiar
        # With familiarity, which the pipeline asks for, a worker keeps half: there its memory stays taken in later stages.
        share = 2 if familiar else 1
        self.model, self.most = model, MAX_VALUES // share // max(1, len(model.langs))
        self.run = _RUN_VALUES // share // max(1, len(model.langs))
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new, self.table, self.known = [], np.empty((0, len(self.model.langs))), np.empty(0)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """Emissions and familiarity of all words by number."""
        if self.new:
            fresh = np.concatenate([self.model.emissions(self.new[i : i + 20_000]) for i in range(0, len(self.new), 20_000)])
            self.table = np.concatenate([self.table, np.exp(fresh - fresh.max(axis=1, keepdims=True))])
            self.known = np.concatenate([self.known, [self.model.familiar(w) for w in self.new] if self.asked else np.ones(len(self.new))])
            self.new = []
        return self.table, self.known


def _chain(ids: np.ndarray, lengths: np.ndarray, e: np.ndarray, model: Model, stretch: int = STRETCH) -> np.ndarray:
    """Mean label probabilities of texts: ids holds their words one after another; lengths fall and are above 0.

    Forward messages are kept at the start of each stretch and made again, stretch by stretch, on the way back.
    """
    k = len(model.langs)
    a, s = np.exp(model.transition - model.transition.max()), np.exp(model.start - model.start.max())
    begin = np.r_[0, np.cumsum(lengths)[:-1]]
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts longer than t

    def forward(first: int, message: np.ndarray | None) -> list[np.ndarray]:
        steps = range(first, min(longest, first + stretch))
        held = np.empty((int(active[first : steps.stop].sum()), k))  # one piece of memory for all messages of the stretch
        out, at = [], 0
        for t in steps:
            n = active[t]
            f = e[ids[begin[:n] + t]] * (s if t == 0 else message[:n] @ a)
            message = held[at : at + n]
            np.divide(f, f.sum(axis=1, keepdims=True), out=message)
            out.append(message)
            at += n
        return out

    before, messages, kept = {0: None}, [], 0
    for first in range(0, longest, stretch):
        messages, kept = forward(first, before[first]), first
        before[first + stretch] = messages[-1].copy()
    total = np.zeros((len(lengths), k))
    back = np.ones((0, k))
    for first in range(kept, -1, -stretch):
        if first != kept:
            messages = []
            messages = forward(first, before[first])
        for t in range(min(longest, first + stretch) - 1, first - 1, -1):
            n = active[t]
            if n > len(back):
                back = np.concatenate([back, np.ones((n - len(back), k))])
            p = messages[t - first] * back
            total[:n] += p / p.sum(axis=1, keepdims=True)
            b = (back * e[ids[begin[:n] + t]]) @ a.T
            back = b / b.sum(axis=1, keepdims=True)
    return total / lengths[:, None]


#: Message values (words times languages) that one run of the chain may need.
_RUN_VALUES = 1_600_000


def predict(texts: list[str | None], model: Model, known: _Words | None = None) -> list[tuple[str, float, float]]:
    """Language, score and familiarity (mean over words of the share of known letter sequences) of each text."""
    out = [(UNKNOWN, 0.0, 0.0)] * len(texts)
    if not len(model.weights):
        return out
    known = _Words(model) if known is None else known
    number = known.__getitem__
    most = max(1, known.run)
    pending: list[tuple[int, np.ndarray]] = []

    def run() -> None:
        pending.sort(key=lambda x: -len(x[1]))
        lengths = np.array([len(x[1]) for x in pending])
        emission, familiar = known.scores()
        mean = _chain(np.concatenate([x[1] for x in pending]), lengths, emission, model)
        for (i, words), m, best in zip(pending, mean, mean.argmax(axis=1)):
            out[i] = (model.langs[best], float(min(1.0, max(0.0, m[best]))), float(familiar[words].mean()))
        pending.clear()

    size = 0
    for i, text in enumerate(texts):
        if text and (words := words_of(text)):
            if size + len(words) > most and pending:
                run()
                size = 0
            if len(known) > known.most and not pending:
                known.reset()
            pending.append((i, np.array(list(map(number, words)), np.int32)))
            size += len(words)
    if pending:
        run()
    return out


def _bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; a null id is no held-out row."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0).cast("long"))


def train(docs: DataFrame, *, held_out: int | None = 2, rows: int = TRAIN_ROWS, row_bytes: int = TRAIN_ROW_BYTES) -> Model:
    """A model from a sample of at most so many labelled rows of docs, as many of each language, picked by hash."""
    # Of a longer text a stretch of so many letters and signs is learned from, so no language is left out for its long texts.
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if held_out is not None:
        labelled = labelled.filter(_bucket(F.col("doc_id")) != held_out)
    # By id and text, so that rows that share an id are drawn one by one; equal texts count once.
    order = F.xxhash64("doc_id", F.xxhash64("text"), F.lit(SEED))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    if not counts:
        return Model([])
    each = max(LEAST_ROWS, -(-rows // len(counts)))
    # Twice the rows wanted pass the threshold on the hash; the window then takes the first of each language.
    schema = pa.schema([("lang", pa.string()), ("__share", pa.float64())])
    shares = few_rows(docs.sparkSession, [(r["lang"], min(1.0, (2 * each + 20) / r["n"])) for r in counts], schema)
    drawn = labelled.select("doc_id", "lang", "text", order.alias("__o")).withColumn("__h", F.pmod("__o", F.lit(1_000_000)) / 1_000_000).join(F.broadcast(shares), "lang").filter("__h <= __share")
    drawn = drawn.withColumn("text", F.when(F.octet_length("text") <= row_bytes, F.col("text")).otherwise(F.substr("text", F.lit(1), F.lit(row_bytes // 4))))
    drawn = drawn.groupBy("lang", F.md5("text").alias("__d")).agg(F.min(F.struct("__o", "text")).alias("x")).select("lang", "__d", "x.__o", "x.text")
    first = F.row_number().over(W.partitionBy("lang").orderBy("__o", "__d"))
    sample = drawn.withColumn("__n", first).filter(F.col("__n") <= each).select("text", "lang").collect()
    return fit(sorted((r["text"], r["lang"]) for r in sample))


def with_language(docs: DataFrame, model: Model, familiar: bool = False) -> DataFrame:
    """docs with __lid: lang, score and (if asked for, else 1) familiar of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 65 536 features and the lexicons, x languages

    @F.pandas_udf("lang string, score double, familiar double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with given_back():
            known, texts = _Words(shared.value, familiar), None
            for texts in batches:
                yield pd.DataFrame(predict(list(texts), shared.value, known), columns=["lang", "score", "familiar"])
            known = texts = None

    return docs.withColumn("__lid", label("text"))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the rows that aren't held out."""
    model = train(docs)
    rows = with_language(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (_bucket(F.col("doc_id")) == 2).alias("held_out"), F.col("__lid")["lang"].alias("lang_pred"), F.col("__lid")["score"].alias("score"))


#: A document of which a smaller share of letter sequences than this is known is in none of the learned languages.
MIN_FAMILIAR = 0.3


def identified(docs: DataFrame, min_familiar: float = MIN_FAMILIAR) -> DataFrame:
    """docs without the rows whose language can't be told: no letters, or words unlike those of all learned languages.

    The measure doesn't depend on how many languages there are, and code-switched texts are as familiar as their parts.
    Where no row has a label there is nothing to learn; then all texts with a letter stay.
    """
    model = train(docs, held_out=None)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows = with_language(docs, model, familiar=True)
    return rows.filter((F.col("__lid")["lang"] != UNKNOWN) & (F.col("__lid")["familiar"] >= min_familiar)).select(docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all documents."""
    return predictions(table(spark, sf_dir, "documents"))
