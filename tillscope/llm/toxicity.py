"""Toxicity scores by a counterfactually regularised classifier.

A logistic model over words and word beginnings, fitted on a bounded sample of
labelled texts. Each sampled text that names a group also gives copies with the
identity term swapped for others of its set. Every sampled text, whatever it
holds, also lends a slot: a copy that names a group in it, and one that names
another of the same set. The squared change of the logit between a text and its
copies is penalised, so that naming a group says little about toxicity. A term
of which no feature was chosen cannot change a score; it gives no copies.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.session import materialise, ship_package

# Sets of identity terms that may stand for each other in a sentence: English, French, German, Spanish.
# Fixed values.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("homosexuels", "hétérosexuels", "lesbiennes", "bisexuels"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("immigrés", "réfugiés", "étrangers"),
    ("vieux", "jeunes"),
    ("handicapés", "sourds", "aveugles"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("homosexuelle", "heterosexuelle", "lesben", "bisexuelle"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("alte", "junge"),
    ("behinderte", "gehörlose", "blinde"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("mujer", "hombre", "chica", "chico"),
    ("homosexuales", "heterosexuales", "lesbianas", "bisexuales"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("viejos", "jóvenes"),
    ("discapacitados", "sordos", "ciegos"),
)

# Labelled rows that the classifier is fitted on.
MAX_LABELLED = 20_000

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6)
_CACHE_ENTRIES = 500_000


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text: runs of letters in lower case."""
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word and its beginnings of 4 to 6 letters."""
    return [word, *(f"{word[:n]}*" for n in _PREFIXES if len(word) > n)]


def counterfactuals(
    words: set[str], terms: Sequence[Sequence[str]] = IDENTITY_TERMS
) -> list[tuple[str, str]]:
    """``(term, other)`` for every swap of an identity term of the text."""
    return [
        (term, other)
        for group in terms
        for term in group
        if term in words
        for other in group
        if other not in words
    ]


def slot_terms(text: str, sets: Sequence[Sequence[str]]) -> tuple[str, str] | None:
    """Two terms of one set to name in a slot of the text, drawn by its hash; None without sets."""
    if not sets:
        return None
    draw = zlib.crc32(text.encode("utf-8", "replace"))
    draw, at = divmod(draw, len(sets))
    draw, first = divmod(draw, len(sets[at]))
    step = 1 + draw % max(1, len(sets[at]) - 1)
    return sets[at][first], sets[at][(first + step) % len(sets[at])]


@dataclass
class Classifier:
    """Weights by feature; the logit is their sum over a text's distinct words.

    ``swapped`` copies of texts with identity terms and ``slotted`` copies of texts
    with a term put in were held against the texts while it was fitted.
    """

    weights: dict[str, float]
    bias: float
    swapped: int = 0
    slotted: int = 0
    known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def word_weight(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= _CACHE_ENTRIES:
                self.known.clear()
            get = self.weights.get
            found = self.known[word] = math.fsum(get(f, 0.0) for f in features_of(word))
        return found

    def score(self, text: str | None) -> float:
        # Summed exactly, so that the order of the words makes no difference.
        logit = self.bias + math.fsum(map(self.word_weight, words_of(text)))
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, logit))))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """``(text, toxic)`` of a bounded sample of labelled rows outside the held-out fold.

    The rows with the smallest hash of the id are taken, at every size of the
    tables; its bound is that of the broadcast. Materialised.
    """
    sample = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id", "toxic")
        .limit(max_labelled)
    )
    return materialise(
        docs.select("doc_id", F.col("text").cast("string"))
        .join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
        .select("text", "toxic")
    )


def choose_features(
    rows: DataFrame,
    n_features: int,
    min_docs: int,
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
) -> list[str]:
    """The features whose share differs most between the classes, by a z statistic.

    Documents are counted per feature in each task before the shuffle; only the
    best ``n_features`` reach the driver. Identity terms and their beginnings are
    always among them where they occur.
    """
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic")):
                found = {f for word in words_of(text.as_py()) for f in features_of(word)}
                tallies[toxic.as_py()].update(found)
        for at, names in _slices(list(tallies[0].keys() | tallies[1].keys()), 20_000):
            yield pa.RecordBatch.from_pydict(
                {
                    "feature": names,
                    "n0": pa.array([tallies[0][f] for f in names], pa.int64()),
                    "n1": pa.array([tallies[1][f] for f in names], pa.int64()),
                }
            )

    counts = (
        rows.mapInArrow(run, "feature string, n0 long, n1 long")
        .groupBy("feature")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(F.col("n0") + F.col("n1") >= min_docs)
    )
    named = sorted({f for group in terms for term in group for f in features_of(term)})
    p0, p1 = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1)
    spread = F.sqrt(p0 * (1 - p0) / n0 + p1 * (1 - p1) / n1)
    best = (
        counts.withColumn("strength", F.abs(p1 - p0) / spread)
        .orderBy(F.desc("strength"), "feature")
        .limit(n_features)
    )
    identity = counts.where(F.col("feature").isin(named))
    return sorted(
        {r["feature"] for r in best.select("feature").collect()}
        | {r["feature"] for r in identity.select("feature").collect()}
    )


def _slices(items: list, size: int) -> Iterator[tuple[int, list]]:
    for at in range(0, len(items), size):
        yield at, items[at : at + size]


def copy_differences(
    text: str, words: set[str], terms: Sequence[Sequence[str]], active: Sequence[Sequence[str]]
) -> tuple[list[tuple[str | None, str]], list[tuple[str | None, str]]]:
    """``(word out, word in)`` of the copies by swaps, and of those by the text's slot.

    A slot takes a term that the text does not name; ``active`` are the sets it is drawn from.
    """
    named = slot_terms(text, active)
    slots = []
    if named is not None and not words.intersection(named):
        slots = [(None, named[0])]
        if named[1] != named[0]:
            slots.append((named[0], named[1]))
    return list(counterfactuals(words, terms)), slots


_ENCODED = ("toxic", "lengths", "at", "times", "swap_lengths", "swap_at", "swap_times", "kinds")


def _encoded(
    rows: DataFrame, features: list[str], terms: Sequence[Sequence[str]]
) -> dict[str, np.ndarray]:
    """The sample as packed integers.

    Per row the label and its features with counts; per copy whose logit can differ
    from its text's the features that differ, and whether it comes from a slot.
    """
    place = {f: n for n, f in enumerate(features)}
    active = [group for group in terms if any(f in place for t in group for f in features_of(t))]

    def tally(words: set[str]) -> Counter:
        return Counter(place[f] for w in words for f in features_of(w) if f in place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[int]] = {name: [] for name in _ENCODED}
            for text, label in zip(batch.column("text"), batch.column("toxic")):
                plain = text.as_py() or ""
                words = words_of(plain)
                own = tally(words)
                out["toxic"].append(label.as_py())
                out["lengths"].append(len(own))
                out["at"] += own.keys()
                out["times"] += own.values()
                for kind, copies in enumerate(copy_differences(plain, words, terms, active)):
                    for before, after in copies:
                        change = tally({after})
                        if before is not None:
                            change.subtract(tally({before}))
                        change = {f: n for f, n in change.items() if n}
                        if change:
                            out["kinds"].append(kind)
                            out["swap_lengths"].append(len(change))
                            out["swap_at"] += change.keys()
                            out["swap_times"] += change.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.array(out[name], "<i4").tobytes()], pa.binary()) for name in _ENCODED],
                list(_ENCODED),
            )

    # At most ``max_labelled`` rows, four bytes per integer.
    packed = rows.mapInArrow(run, ", ".join(f"{name} binary" for name in _ENCODED)).collect()
    return {
        name: np.frombuffer(b"".join(bytes(r[name]) for r in packed), "<i4").astype(np.int64)
        for name in _ENCODED
    }


def fit(
    labels: np.ndarray,
    rows: tuple[np.ndarray, np.ndarray, np.ndarray],
    swaps: tuple[np.ndarray, np.ndarray, np.ndarray],
    n_features: int,
    fairness: float = 1.0,
    ridge: float = 2e-4,
    rounds: int = 300,
) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent with restarts.

    Minimises mean log loss + ridge |w|^2 / 2 + fairness * mean (w . d)^2 / 2 over
    the swaps' feature differences d. Both matrices are given as (row, column,
    value).
    """
    n, at, value = len(labels), rows[1], rows[2].astype(float)
    n_swaps = int(swaps[0].max()) + 1 if len(swaps[0]) else 0
    # Columns are scaled to unit length, so that one step size suits them all.
    norm = np.sqrt(np.bincount(at, value**2, n_features) / max(n, 1)) + 1e-2
    value = value / norm[at]
    change = swaps[2] / norm[swaps[1]] if n_swaps else swaps[2].astype(float)

    def loss_and_gradient(w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        logits = b + np.bincount(rows[0], value * w[at], n)
        wrong = 1.0 / (1.0 + np.exp(-np.clip(logits, -700, 700))) - labels
        loss = np.mean(np.logaddexp(0.0, logits) - labels * logits)
        gradient = np.bincount(at, value * wrong[rows[0]], n_features) / n
        loss += 0.5 * ridge * w @ w
        gradient += ridge * w
        if n_swaps:
            moved = np.bincount(swaps[0], change * w[swaps[1]], n_swaps)
            loss += 0.5 * fairness * np.mean(moved**2)
            gradient += (
                fairness * np.bincount(swaps[1], change * moved[swaps[0]], n_features) / n_swaps
            )
        return loss, gradient, float(wrong.mean())

    w, b = np.zeros(n_features), math.log((labels.sum() + 1) / (n - labels.sum() + 1))
    ahead_w, ahead_b, pace, step = w, b, 1.0, 1.0
    for _ in range(rounds):
        loss, gradient, gb = loss_and_gradient(ahead_w, ahead_b)
        size = gradient @ gradient + gb * gb
        while True:  # halve the step until it lowers the loss enough
            new_w, new_b = ahead_w - step * gradient, ahead_b - step * gb
            if loss_and_gradient(new_w, new_b)[0] <= loss - 0.5 * step * size or step < 1e-8:
                break
            step /= 2
        if (new_w - w) @ gradient + (new_b - b) * gb > 0:
            pace = 1.0  # the momentum points uphill
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        push = (pace - 1) / faster
        ahead_w, ahead_b = new_w + push * (new_w - w), new_b + push * (new_b - b)
        w, b, pace, step = new_w, new_b, faster, step * 1.2
    return w / norm, b


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = MAX_LABELLED,
    n_features: int = 4096,
    min_docs: int = 3,
    fairness: float = 1.0,
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
) -> Classifier:
    """Fit on at most ``max_labelled`` labelled rows outside the held-out fold.

    ``terms`` are the sets of identity terms, in lower case; ``fairness`` weighs the
    penalty on copies that name other groups.

    Without labels of both kinds the score is the share of toxic labels, or 0.5
    where there is none.
    """
    ship_package(docs.sparkSession)
    rows = training_rows(docs, labels, max_labelled)
    features = choose_features(rows, n_features, min_docs, terms)
    found = _encoded(rows, features, terms)
    y = found["toxic"].astype(float)
    if not features:
        return Classifier({}, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))

    def triples(places: str, values: str, lengths: str) -> tuple:
        owners = np.repeat(np.arange(len(found[lengths])), found[lengths])
        return owners, found[places], found[values]

    own, swaps = triples("at", "times", "lengths"), triples("swap_at", "swap_times", "swap_lengths")
    w, b = fit(y, own, swaps, len(features), fairness)
    slotted = int(found["kinds"].sum())
    weights = {f: float(v) for f, v in zip(features, w) if v}
    return Classifier(weights, float(b), len(found["kinds"]) - slotted, slotted)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row, from the whole text.

    A null or empty text has the score of the bias alone. Repeated rows and rows
    without an id stay (the latter are not held out); other columns are dropped.
    """
    ship_package(docs.sparkSession)
    weights, bias = classifier.weights, classifier.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(weights, bias)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(run, "doc_id long, score double")
        .select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            "score",
            (F.col("score") >= 0.5).cast("int").alias("predicted"),
        )
    )
