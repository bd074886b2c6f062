"""Language of words and texts by a linear-chain conditional random field.

The labels of a text's words form a chain. A word's emission is the sum of the weights of its
features: prefixes and suffixes, letter pairs and triples with word ends marked, and the
languages whose lexicon of frequent words has it. Transitions are learned with them. Forward
and backward passes give each word's distribution over the labels; so a text may switch
between languages at any word, and its own language is the one with the largest mean share.

Learning: from a bounded sample of labelled texts, about `TEXTS_PER_LANGUAGE` of each and a
run of `WORDS_PER_TEXT` words of each. As a text has one label, runs of different languages
are joined to code-switched sequences. Weights start from smoothed log frequencies and then
follow the gradient of the chain's likelihood.

Scripts without spaces, and other very long words: consecutive pieces of `WORD_CHARS`
characters stand for words, in learning and in applying, so that every character counts.

Applying: all words of all texts, in Arrow batches. Words are few and occur often, so the
features of a word are worked out once per worker and table; the passes run over many texts
at once, one step per position.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.words import INK

TEXTS_PER_LANGUAGE = 600
WORDS_PER_TEXT = 80
WORD_CHARS = 48  # a longer word is parted into pieces, each a position of the chain
LEXICON_WORDS = 1000
LEAST_COUNT = 3
RUN_WORDS = (4, 30)  # words of one language in a row, in training sequences
STEPS = 30
SEED = 20240104
UNKNOWN = "und"
FLUSH_WORDS = 1 << 21
TABLE_WORDS = 300_000
SLICE_CHARS = 1 << 20


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def core(word: str) -> str:
    """A word in lower case, without marks around it."""
    word = word.lower()
    if not word.isalpha():
        first, last = 0, len(word)
        while first < last and not word[first].isalpha():
            first += 1
        while last > first and not word[last - 1].isalpha():
            last -= 1
        word = word[first:last]
    return word


def pieces(text: str) -> list[str]:
    """The words of a text, those longer than `WORD_CHARS` in consecutive pieces."""
    words = text.split()
    if max(map(len, words), default=0) > WORD_CHARS:
        words = [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]
    return words


def features(word: str) -> list[str]:
    """Of a core: itself first, then affixes, letter pairs and triples with word ends marked."""
    ends = f"<{word}>"
    return [
        "=" + word,
        "^" + word[:4],
        word[-4:] + "$",
        *[ends[i : i + 2] for i in range(len(ends) - 1)],
        *[ends[i : i + 3] for i in range(len(ends) - 2)],
    ]


@dataclass
class Crf:
    """Weights of features (rows) and labels (columns), and of label after label."""

    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    lexicons: list[frozenset[str]]
    lexicon_weights: np.ndarray

    def __post_init__(self):
        self.in_lexicon = frozenset().union(*self.lexicons)

    def emissions(self, words: Sequence[str]) -> np.ndarray:
        """Scores of each word's core, words by labels."""
        ids, counts = [], []
        lexicon = np.zeros((len(words), len(self.labels)), dtype=np.float32)
        get = self.index.get
        for at, word in enumerate(words):
            names = features(word)
            known = [i for i in map(get, names) if i is not None]
            ids += known
            counts.append(len(known))
            if names[0] in self.in_lexicon:
                lexicon[at] = [names[0] in held for held in self.lexicons]
        sums = np.zeros((len(words), len(self.labels)), dtype=np.float32)
        if ids:
            rows = np.repeat(np.arange(len(words)), counts)
            for label in range(len(self.labels)):
                sums[:, label] = np.bincount(rows, self.weights[ids, label], minlength=len(words))
        # A lexicon's languages share what its weight adds to the score.
        return sums + lexicon @ self.lexicon_weights

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Distribution over labels of every word. ``scores`` holds the words of all texts one
        after another, ``lengths`` how many each has, none of them 0."""
        order = np.argsort(-lengths, kind="stable")
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        sizes = lengths[order]
        # Texts are sorted by length, so those that have a word at a step are the first ones.
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        emit = np.exp(scores - scores.max(axis=1, keepdims=True))
        step = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        out = np.empty_like(emit)
        state = None
        for t in range(sizes[0]):
            rows = begin[: active[t]] + t
            state = emit[rows] if t == 0 else (state[: active[t]] @ step) * emit[rows]
            state = state / state.sum(axis=1, keepdims=True)
            out[rows] = state
        after = np.ones((0, scores.shape[1]), dtype=np.float32)
        for t in range(sizes[0] - 1, -1, -1):
            rows = begin[: active[t]] + t
            later = np.ones((active[t], scores.shape[1]), dtype=np.float32)
            later[: len(after)] = after
            both = out[rows] * later
            out[rows] = both / both.sum(axis=1, keepdims=True)
            after = (later * emit[rows]) @ step.T
            after /= after.sum(axis=1, keepdims=True)
        return out


# Learning -----------------------------------------------------------------------------


def training_runs(docs: DataFrame, texts: int = TEXTS_PER_LANGUAGE, words: int = WORDS_PER_TEXT) -> list[tuple[str, list[str]]]:
    """(language, words) of about ``texts`` texts of each language, a run of ``words`` words
    (or pieces of long words) from anywhere in each; ``docs`` has ``text`` and ``lang``. A digest of the text draws, so
    that equal texts are drawn together, and then count once."""
    rows = docs.filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("_texts"))
    share = (F.lit(float(texts)) / F.col("_texts") * (1 << 31)).cast("long")
    shares = counts.select("lang", share.alias("_share"))
    draw = F.xxhash64("text", F.lit(SEED))
    # One row per language.
    chosen = rows.select("lang", "text", draw.alias("_draw")).join(F.broadcast(shares), "lang")
    chosen = chosen.filter(F.pmod("_draw", F.lit(1 << 31)) < F.col("_share"))
    found = F.regexp_extract_all("text", F.lit(rf"{INK}{{1,{WORD_CHARS}}}"), F.lit(0))
    room = F.greatest(F.size("_w") - words, F.lit(0)) + 1
    start = F.pmod("_draw", room).cast("int") + 1
    cut = chosen.select("lang", "_draw", found.alias("_w")).select("lang", "_draw", F.slice("_w", start, words).alias("words"))
    runs = [(r["lang"], [core(w) for w in r["words"] if has_letter(w)]) for r in cut.distinct().orderBy("lang", "_draw", "words").collect()]
    return [r for r in runs if r[1]]


def code_switched(runs: Sequence[tuple[str, list[str]]], labels: Sequence[str], seed: int = SEED) -> list[list[tuple[str, int]]]:
    """Sequences of (word, label) in which runs of different languages follow each other."""
    draw = np.random.Generator(np.random.PCG64(seed))
    place = {label: i for i, label in enumerate(labels)}
    pieces = []
    for lang, words in runs:
        at = 0
        while at < len(words):
            size = int(draw.integers(RUN_WORDS[0], RUN_WORDS[1] + 1))
            pieces.append([(w, place[lang]) for w in words[at : at + size]])
            at += size
    pieces = [pieces[i] for i in draw.permutation(len(pieces))]
    return [[pair for piece in pieces[at : at + 4] for pair in piece] for at in range(0, len(pieces), 4)]


def learn(runs: Sequence[tuple[str, list[str]]], steps: int = STEPS) -> Crf | None:
    """A model of the languages in ``runs``; none without any."""
    labels = sorted({lang for lang, _ in runs})
    if not labels:
        return None
    sequences = code_switched(runs, labels)
    counts = [Counter() for _ in labels]
    frequent = [Counter() for _ in labels]
    for sequence in sequences:
        for word, label in sequence:
            names = features(word)
            counts[label].update(names)
            frequent[label][names[0]] += 1
    total = Counter()
    for c in counts:
        total.update(c)
    names = sorted(n for n, c in total.items() if c >= LEAST_COUNT)
    index = {n: i for i, n in enumerate(names)}
    table = np.array([[c[n] for c in counts] for n in names], dtype=np.float64).reshape(len(names), len(labels)) + 0.5
    logs = np.log(table / table.sum(axis=0))
    weights = ((logs - logs.mean(axis=1, keepdims=True)) / 4).astype(np.float32)
    lexicons = [frozenset(w for w, c in f.most_common(LEXICON_WORDS) if c >= LEAST_COUNT) for f in frequent]
    size = len(labels)
    model = Crf(labels, index, weights, np.eye(size, dtype=np.float32) * 2, lexicons, np.eye(size, dtype=np.float32))

    words = sorted({w for s in sequences for w, _ in s})
    row = {w: i for i, w in enumerate(words)}
    tokens = np.array([row[w] for s in sequences for w, _ in s])
    truth = np.array([label for s in sequences for _, label in s])
    lengths = np.array([len(s) for s in sequences])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inner = np.setdiff1d(np.arange(len(tokens)), starts)  # words with one before them
    listed = [[i for i in map(index.get, features(w)) if i is not None] for w in words]
    of_word = np.repeat(np.arange(len(words)), [len(x) for x in listed])
    of_feature = np.array([i for x in listed for i in x], dtype=np.int64)
    held = np.array([[float(features(w)[0] in lex) for lex in lexicons] for w in words]).reshape(len(words), size)
    one_hot = np.eye(size)[truth]
    seen = np.zeros((size, size))
    np.add.at(seen, (truth[inner - 1], truth[inner]), 1)
    speed = [np.full_like(a, 1e-6, dtype=np.float64) for a in (model.weights, model.transitions, model.lexicon_weights)]
    for _ in range(steps if size > 1 else 0):
        scores = np.stack(
            [np.bincount(of_word, model.weights[of_feature, l], minlength=len(words)) for l in range(size)], axis=1
        ) + held @ model.lexicon_weights
        shares = model.marginals(scores[tokens].astype(np.float32), lengths)
        gap = one_hot - shares
        by_word = np.stack([np.bincount(tokens, gap[:, l], minlength=len(words)) for l in range(size)], axis=1)
        by_feature = np.stack([np.bincount(of_feature, by_word[of_word, l], minlength=len(names)) for l in range(size)], axis=1)
        # Expected transitions, from the marginals of neighbours.
        step = np.exp(model.transitions)
        joint = shares[inner - 1][:, :, None] * step[None] * shares[inner][:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        gradients = [by_feature - 0.01 * model.weights, seen - joint.sum(axis=0), held.T @ by_word]
        for value, gradient, sums in zip((model.weights, model.transitions, model.lexicon_weights), gradients, speed):
            sums += gradient**2
            value += (0.1 * gradient / np.sqrt(sums)).astype(np.float32)
    return model


# Applying -----------------------------------------------------------------------------


class _Table:
    """Emissions of words met before, in a worker; words with the same core share a row."""

    def __init__(self, model: Crf):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.cores: dict[str, int] = {}
        self.scores = np.empty((1 << 14, len(self.model.labels)), dtype=np.float32)

    def reset_if_full(self) -> None:
        if len(self.rows) > TABLE_WORDS:
            self._clear()

    def rows_of(self, texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """Table rows of the words with a letter of each text, in order."""
        new: dict[str, None] = {}
        for word in set().union(*texts).difference(self.rows):
            if has_letter(word):
                at = core(word)
                if at not in self.cores:
                    self.cores[at] = len(self.cores)
                    new[at] = None
                self.rows[word] = self.cores[at]
            else:
                self.rows[word] = -1
        if new:
            end = len(self.cores)
            if end > len(self.scores):
                more = np.empty((max(end, 2 * len(self.scores)), self.scores.shape[1]), dtype=np.float32)
                more[: end - len(new)] = self.scores[: end - len(new)]
                self.scores = more
            self.scores[end - len(new) : end] = self.model.emissions(list(new))
        get = self.rows.__getitem__
        found = [np.fromiter(map(get, words), dtype=np.int32, count=len(words)) for words in texts]
        return [f[f >= 0] for f in found]


def _slices(text: str) -> Iterator[str]:
    """A text in slices of bounded size, cut at white space where there is any."""
    at = 0
    while at < len(text):
        end = at + SLICE_CHARS
        while end < len(text) and not text[end].isspace() and end < at + 2 * SLICE_CHARS:
            end += 1
        yield text[at:end]
        at = end


def _labelled(batches: Iterator[pa.RecordBatch], model: Crf) -> Iterator[pa.RecordBatch]:
    table = _Table(model)
    names = np.array(model.labels, dtype=object)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            table.reset_if_full()
            rows, words, start = [], 0, at
            while at < batch.num_rows and words < FLUSH_WORDS and len(table.rows) <= TABLE_WORDS:
                # Some texts at once, a very long one in slices.
                slices, owners, chars = [], [], 0
                while at < batch.num_rows and len(slices) < 256 and chars < SLICE_CHARS:
                    text = batch.column(1)[at].as_py() or ""
                    at += 1
                    rows.append(np.empty(0, dtype=np.int32))
                    chars += len(text)
                    for piece in _slices(text):
                        slices.append(pieces(piece))
                        owners.append(len(rows) - 1)
                for owner, found in zip(owners, table.rows_of(slices)):
                    rows[owner] = np.concatenate([rows[owner], found]) if len(rows[owner]) else found
                    words += len(found)
            lengths = np.array([len(r) for r in rows])
            labels = np.full(len(rows), UNKNOWN, dtype=object)
            score = np.zeros(len(rows))
            full = np.flatnonzero(lengths)
            if len(full):
                shares = model.marginals(table.scores[np.concatenate(rows)], lengths[full])
                starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
                means = np.add.reduceat(shares.astype(np.float64), starts, axis=0) / lengths[full][:, None]
                labels[full] = names[means.argmax(axis=1)]
                score[full] = np.clip(means.max(axis=1), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.slice(start, at - start).columns[:1], pa.array(labels, pa.string()), pa.array(score)],
                names=["id", "lang_pred", "score"],
            )


def label_texts(docs: DataFrame, model: Crf | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, lang_pred, score`` of every row. A missing text, and one without a letter, is
    `UNKNOWN` with score 0, as is every text where the model has no language. Ties go to the
    first language by name. Repeated rows are labelled alike."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_column), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lambda b: _labelled(b, shared.value), f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_column)


def word_labels(text: str, model: Crf) -> list[tuple[str, str, float]]:
    """(word, language, share) of the `pieces` with a letter in one text, for code-switched text."""
    words = [w for w in pieces(text) if has_letter(w)]
    if not words:
        return []
    shares = model.marginals(model.emissions([core(w) for w in words]), np.array([len(words)]))
    return [(w, model.labels[int(s.argmax())], float(s.max())) for w, s in zip(words, shares)]


def learned_from(docs: DataFrame) -> Crf | None:
    """The model of a bounded sample of ``docs`` (text, lang)."""
    return learn(training_runs(docs))
