"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Words are compared by the gapped subsequence kernel: common subsequences of ORDER letters,
each letter they span costing a factor DECAY. Insults with inserted, dropped or split-up
letters, or with unknown endings, stay close to what was learned. A word's features are its
kernel values to a fixed set of landmarks, mapped by the inverse root of the landmarks' own
kernel matrix (Nyström); a linear machine on them gives the word's margin. A
sentence is as toxic as its worst word; a text is scored by its worst sentence and by the
weight of all words on the toxic side, on a logistic scale.

Training reads a bounded sample of labelled rows (SAMPLE_ROWS of each label, by a digest of
their text). Their distinct sentences carry the label of their text; a word or word
beginning that keeps turning up in toxic sentences and hardly ever in clean ones marks the
witness words of the toxic side, all words of clean sentences are the other side. Only
counts by word and the chosen words reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations
from tempfile import TemporaryFile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..session import staged
from .words import forget, text_slices

ORDER, DECAY = 3, 0.6
LETTERS = 24  # longer words are read in overlapping pieces of this length
LANDMARKS = 256
SAMPLE_ROWS = 4000
WORDS = 60_000  # clean words fetched for training: a bound on the training sample, as SAMPLE_ROWS is
SUSPECTS = 2000  # toxic words and beginnings fetched, likewise
CLEAR = 0.45  # margins from here on count as evidence
REMEMBERED = 600_000  # words whose margin a worker remembers
SLICE_CHARS = 1 << 18  # texts whose words are held at once; the words take some 20 bytes per character
_LETTER = re.compile(r"[\W\d_]+")
_SPLIT_UP = re.compile(r"(?<!\S)\S(?:[ .\-_*]\S){2,}(?!\S)")


def letters_of(raw: str) -> str:
    """Letters of a lower-case word; marks and digits put between them vanish."""
    return _LETTER.sub("", raw)


def words_of(text: str) -> set[str]:
    """Distinct raw words of a text, with words spelt out letter by letter put together."""
    text = text.lower()
    found = set(text.split())
    for spelt in _SPLIT_UP.findall(text):
        found.add(letters_of(spelt))
    return found


def _codes(words: list[str]) -> np.ndarray:
    """Letters as numbers, one row per word, 0 after its end."""
    return np.array(words, dtype=f"U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS) if words else np.zeros((0, LETTERS), np.uint32)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each row of a with the same row of b."""
    n, width = a.shape
    spread = np.triu(DECAY ** np.maximum(0, np.subtract.outer(np.arange(width), np.arange(width)).T))
    before = [np.ones((n, width + 1))] + [np.zeros((n, width + 1)) for _ in range(ORDER - 1)]
    total = np.zeros(n)
    for i in range(width):
        letter = a[:, i]
        if not letter.any():
            break
        same = (b == letter[:, None]) & (letter > 0)[:, None]
        total += DECAY**2 * (before[ORDER - 1][:, :-1] * same).sum(axis=1)
        for k in range(ORDER - 1, 0, -1):
            ends = DECAY**2 * (before[k - 1][:, :-1] * same)
            before[k][:, 1:] = DECAY * before[k][:, 1:] + ends @ spread
    return total


# Scale before one was learned: no word on the toxic side scores low.
EVEN = (0.0, 3.0, 0.0, 0.0)


@cache
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of ORDER letters in a word of that length, and the factor each costs."""
    at = np.array(list(combinations(range(length), ORDER)))
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


@dataclass
class Model:
    """Landmarks, the machine's weights, and the scale of scores.

    The kernel is the inner product of words' subsequences, so the kernel values of a word to
    all landmarks, and their weighted sum, follow from the word's own subsequences alone:
    each is looked up among those of the landmarks. No value is left out or approximated.

    ``scale`` has the weights of 1, of a text's largest margin, and of the logarithms of the
    sum of its clear margins and of the number of its different words.
    """

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    scale: tuple[float, ...]

    def __post_init__(self) -> None:
        self.letters = np.unique(self.codes[self.codes > 0])
        parts = list(self._subsequences(self.codes))
        empty = np.zeros((0, 1), np.int64)
        self.keys, self.place = np.unique(np.vstack([empty, *[keys.reshape(-1, 1) for _, keys, _ in parts]]), return_inverse=True)
        self.place = self.place.ravel()
        self.mark = np.concatenate([empty.ravel(), *[np.repeat(rows, keys.shape[1]) for rows, keys, _ in parts]])
        self.cost = np.concatenate([np.zeros(0), *[cost.ravel() for _, _, cost in parts]])

    def _subsequences(self, codes: np.ndarray, slices: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, keys, costs) of the subsequences of words of equal length, about ``slices`` at a time.

        Costs are divided by the root of the word's self-kernel. Letters that no landmark has
        are one letter, 0.
        """
        place = np.minimum(np.searchsorted(self.letters, codes), max(0, len(self.letters) - 1))
        known = (self.letters[place] == codes) if len(self.letters) else np.zeros(codes.shape, bool)
        index, base = np.where(known, place + 1, 0).astype(np.int64), len(self.letters) + 1
        lengths = (codes > 0).sum(axis=1)
        for length in range(ORDER, LETTERS + 1):
            at, factor = _places(length)
            rows = np.flatnonzero(lengths == length)
            for lo in range(0, len(rows), max(1, slices // len(at))):
                some = rows[lo : lo + max(1, slices // len(at))]
                keys = np.zeros((len(some), len(at)), dtype=np.int64)
                for letter in range(ORDER):
                    keys = keys * base + index[some][:, at[:, letter]]
                own = kernel(codes[some, :length], codes[some, :length])
                yield some, keys, factor / np.sqrt(own)[:, None]

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        """Places of subsequences among those of the landmarks; the one after the last for all others."""
        if not len(self.keys):
            return np.zeros(keys.shape, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, len(self.keys))

    def feature_blocks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, normalised kernels with each landmark) of some words at a time; words that
        are too short for a subsequence, whose kernels are 0, are left out."""
        shares = np.zeros((len(self.keys) + 1, len(self.codes)))
        np.add.at(shares, (self.place, self.mark), self.cost)
        for lo in range(0, len(words), 4096):
            for some, keys, cost in self._subsequences(_codes(words[lo : lo + 4096]), 1 << 12):
                yield lo + some, np.einsum("nt,ntm->nm", cost, shares[self._rows(keys)])

    def features(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of each word with each landmark."""
        out = np.zeros((len(words), len(self.codes)))
        for some, values in self.feature_blocks(words):
            out[some] = values
        return out

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word of letters."""
        out = np.full(len(words), self.bias)
        heights = np.bincount(self.place, self.cost * self.weights[self.mark], len(self.keys) + 1)
        for lo in range(0, len(words), 4096):
            for some, keys, cost in self._subsequences(_codes(words[lo : lo + 4096])):
                out[lo + some] += (heights[self._rows(keys)] * cost).sum(axis=1)
        return out


def evidence(largest: float, strength: float, words: int) -> tuple[float, ...]:
    return 1.0, min(max(largest, -1.0), 1.5), float(np.log(strength + 0.1)), float(np.log(words + 10))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; the last column of x is 1.

    x is read 4,096 rows at a time, so it may lie in a file.
    """
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(40):
        curve, target = penalty.copy(), np.zeros(len(w))
        for lo in range(0, len(x), 4096):
            rows, side = np.asarray(x[lo : lo + 4096]), y[lo : lo + 4096]
            pull = np.where(side * (rows @ w) < 1, weight[lo : lo + 4096], 0.0)
            curve += (rows * pull[:, None]).T @ rows
            target += rows.T @ (pull * side)
        step = np.linalg.solve(curve, target)
        if np.abs(step - w).max() < 1e-9:
            break
        w = step
    return w[:-1], float(w[-1])


def _first_model(strings: list[str]) -> Model:
    return Model(_codes(strings), np.zeros(len(strings)), -1.0, EVEN)


def fit_words(suspects: list[tuple[str, int, int]], toxic: list[str], clean: list[tuple[str, int]]) -> Model:
    """Model from suspect strings (with their counts), words of toxic sentences, and words of clean sentences."""
    nothing = _first_model([])
    names = [s for s, _, _ in suspects]
    known = set(names)
    positive = sorted({w for w in toxic if any(w[:n] in known for n in range(4, len(w) + 1))})
    negative = [w for w, _ in clean if not any(w[:n] in known for n in range(4, len(w) + 1))]
    if not positive:
        return nothing
    marks: list[str] = []
    gram = _gram(names)
    for i, name in enumerate(names):
        if len(marks) < LANDMARKS * 3 // 4 and not (gram[i, [names.index(x) for x in marks]] > 0.97).any():
            marks.append(name)
    # The same words with a letter put in or left out: writers hide insults so.
    top = [w for w in positive if len(w) > 4][:: max(1, len(positive) // 300)]
    hidden = sorted({w[:k] + "x" + w[k:] for w in top for k in range(1, len(w), 2)} | {w[:k] + w[k + 1 :] for w in top for k in range(2, len(w) - 1, 3) if len(w) > 5})
    if negative:  # clean words nearest to them keep the machine from reaching too far
        near = np.zeros(len(negative))
        for some, values in _first_model(marks).feature_blocks(negative):
            near[some] = values.max(axis=1)
        marks += [negative[i] for i in np.argsort(-near, kind="stable")[: LANDMARKS - len(marks)] if near[i] > 0]
    marks = list(dict.fromkeys(marks))
    model = _first_model(marks)
    gram = _gram(marks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-6
    root = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
    # The last row, of zeros, is a word that shares nothing with any landmark. The rows, WORDS
    # on either side at most, lie in a file of the driver: they are needed a block at a time.
    words = positive + hidden + negative
    x = np.memmap(TemporaryFile(), np.float64, "w+", shape=(len(words) + 1, len(marks) + 1))
    x[:, -1] = 1
    for some, values in model.feature_blocks(words):
        x[some, :-1] = values @ root
    n_good, n_bad = len(positive) + len(hidden), len(negative)
    y = np.concatenate([np.ones(n_good), -np.ones(n_bad + 1)])
    shares = np.concatenate([np.full(len(positive), 1 / len(positive)), np.full(len(hidden), 0.5 / max(1, len(hidden))), np.full(n_bad, 3 / max(1, n_bad)), [1.0]])
    weights, bias = _machine(x, y, shares * 100)
    model.weights, model.bias = root @ weights, min(bias, -0.2)
    return model


def _gram(strings: list[str]) -> np.ndarray:
    """Normalised kernel matrix."""
    codes = _codes(strings)
    own = np.sqrt(np.maximum(kernel(codes, codes), 1e-30))
    rows = [kernel(codes, np.repeat(codes[i : i + 1], len(strings), axis=0)) for i in range(len(strings))]
    gram = np.array(rows).reshape(len(strings), len(strings)) / np.outer(own, own)
    return (gram + gram.T) / 2


def _scale(seen: list[tuple[float, float, int, int]]) -> tuple[float, ...]:
    """Logistic weights of the evidence, from (largest margin, strength, words, label) of the sample."""
    if len({y for *_, y in seen}) < 2:
        return EVEN
    x = np.array([evidence(*row[:3]) for row in seen])
    y = np.array([row[3] for row in seen], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (y - p) - 0.5 * w)
    return tuple(map(float, w))


def sampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(name, text, label): of each label the ``rows`` distinct texts with the smallest digests.

    Only ids, digests and labels are shuffled. Digests are counted by their first letters,
    those behind the letters that hold the sample are dropped, and the texts of the chosen
    ids, 2 * ``rows`` at most, are fetched by a join with that bounded list. A text with
    both labels counts as 1. NULL ids and texts and labels other than 0 and 1 take no part.
    """
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").distinct()
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    names = texts.select("id", F.sha2("text", 256).alias("name")).join(known, "id")
    names = staged(names.groupBy("name").agg(F.max("label").alias("label"), F.min("id").alias("id")), "names")
    # At most 16 ** 4 counts of each label.
    head = F.substring("name", 1, 4)
    counts = names.groupBy("label", head.alias("head")).count()
    sofar = F.sum("count").over(Window.partitionBy("label").orderBy("head")) - F.col("count")
    ends = {r.label: r.head for r in counts.withColumn("before", sofar).where(F.col("before") < rows).groupBy("label").agg(F.max("head").alias("head")).collect()}
    first = lambda value: names.where((F.col("label") == value) & (head <= ends.get(value, ""))).orderBy("name").limit(rows)
    chosen = staged(first(1).unionAll(first(0)), "chosen")
    found = texts.join(F.broadcast(chosen), "id").where(F.sha2("text", 256) == F.col("name"))
    # Repeated rows of one id and text are one sample.
    return found.groupBy("name").agg(F.first("text").alias("text"), F.first("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the texts of ``docs`` that ``labels`` marks 0 or 1, joined by ``key``; see ``sampled``.

    Without a word on either side the model knows nothing and scores every text low. Ties
    between words go by their letters, so the same rows give the same model.
    """
    sample = staged(sampled(docs, labels, key, text, label, rows), "sample")
    cores = sample.sparkSession.sparkContext.defaultParallelism
    sentences = sample.repartition(cores, "name").select("label", F.explode(F.split(F.lower("text"), r"[.!?\n]+")).alias("sentence")).distinct()
    bare = F.transform(F.split("sentence", r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}]+", ""))
    words = sentences.select("label", F.explode(F.array_distinct(bare)).alias("word")).where("length(word) > 1").groupBy("word").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    )
    words = staged(words, "words")
    totals = words.agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).first()
    if not totals or not totals.a or not totals.b:
        return fit_words([], [], [])
    # Words and their beginnings: how far their share in toxic sentences is from chance.
    begin = F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.least(F.lit(8), F.length("word")))), lambda n: F.substring(F.col("word"), F.lit(1), n))
    strings = words.select(F.explode(F.array_distinct(F.concat(begin, F.array("word")))).alias("string"), "toxic", "clean").where("length(string) >= 4").groupBy("string").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = totals.a / (totals.a + totals.b)
    surprise = F.col("toxic") * F.log(F.col("toxic") / ((F.col("toxic") + F.col("clean")) * share))
    suspects = strings.where((F.col("toxic") > 0) & (F.col("toxic") >= 2 * F.col("clean"))).withColumn("surprise", surprise).where("surprise >= 8").orderBy(F.desc("surprise"), "string").limit(SUSPECTS).collect()
    toxic = words.where("toxic > 0").orderBy(F.desc("toxic"), "word").limit(WORDS).select("word").collect()
    clean = words.where("clean > 0").orderBy(F.xxhash64("word"), "word").limit(WORDS).select("word", "clean").collect()
    model = fit_words([(r.string, r.toxic, r.clean) for r in suspects], [r.word for r in toxic], [(r.word, r.clean) for r in clean])
    seen = examine(sample.select("text", "label").repartition(cores), model).select("largest", "strength", "words", "label").collect()
    model.scale = _scale([tuple(r) for r in seen])
    return model


def examine(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with the evidence of each whole text: ``largest`` margin, ``strength`` (sum of the clear ones, each 1 at most), different ``words``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model = shared.value
        known: dict[str, float] = {}
        for batch in batches:
            row, column = batch.columns
            largest, strength, counts = [], [], []
            for some in text_slices(column.to_pylist(), SLICE_CHARS):
                found = [words_of(t) if t else set() for t in some]
                met = set().union(*found)
                if len(known) > REMEMBERED:
                    known = {}
                new = list(met.difference(known))
                bare = [letters_of(w) for w in new]
                pieces = [(k, b[i : i + LETTERS]) for k, b in enumerate(bare) for i in range(0, max(1, len(b) - LETTERS // 2), LETTERS // 2)]
                margin = np.full(len(new), model.bias)
                if pieces:
                    np.maximum.at(margin, [k for k, _ in pieces], model.margins([p for _, p in pieces]))
                known.update(zip(new, margin.tolist()))
                for words in found:
                    margins = list(map(known.__getitem__, words))
                    top = max(margins, default=model.bias)
                    largest.append(top)
                    strength.append(sum([min(m, 1.0) for m in margins if m >= CLEAR]) if top >= CLEAR else 0.0)
                    counts.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(largest, pa.float64()), pa.array(strength, pa.float64()), pa.array(counts, pa.int64())], names=["row", "largest", "strength", "words"]
            )

    wide = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(text).alias("text"))
    schema = StructType([wide.schema["row"], StructField("largest", DoubleType()), StructField("strength", DoubleType()), StructField("words", LongType())])
    done = wide.mapInArrow(run, schema)
    return done.select(*[F.col("row")[c].alias(c) for c in df.columns], "largest", "strength", "words")


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with the toxicity of each whole text, 0 to 1; NULL and empty texts get the score of no words.

    The model's size is fixed by its parameters. All other columns pass; one that is called
    ``out`` is replaced.
    """
    df = df.drop(out)
    row = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(text).alias("text"))
    one, largest, strength, words = model.scale
    z = F.lit(one) + largest * F.least(F.greatest("largest", F.lit(-1.0)), F.lit(1.5)) + strength * F.log(F.col("strength") + 0.1) + words * F.log(F.col("words") + 10)
    return examine(row, model).select("row.*", (1 / (1 + F.exp(-z))).alias(out))
