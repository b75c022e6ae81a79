"""Toxic passages by maximum-scoring segments.

Words and their beginnings get log-odds of standing in a toxic rather than a
clean document, for or against, smoothed by a Dirichlet prior in proportion to
how common they are. A token counts if its log-odds are significant; one that
speaks for toxicity must also stand in more toxic than clean documents, or
every rare word would. One linear scan finds every maximal segment of a text
whose log-odds sum is positive; how large the best sum of a clean text of that
length gets follows an extreme-value law, whose fit on clean training rows
turns sums into surprise, and a logistic curve turns the surprise of a document
into its score.

The fit uses at most TRAIN_ROWS labelled ids, chosen by a hash of the id, one
row of each, and of rows that share their smallest shingle only one, so that
copies don't count as evidence. All tokens with evidence are kept: as each stands
in FEWEST of these rows at least, they are bounded by the rows' texts. Defined results: null text counts as empty and
has no passage; without labelled rows of both kinds each score is 0; of several
labels of one document the largest counts; repeated rows are each scored; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_where, release, rows_of, stage_table, text_bytes, texts_of, trim
from .ngram_join import shingle_sets
from .quality import FIT_PARTITIONS, training_rows

TRAIN_ROWS = 40_000
#: Strength of the Dirichlet prior in documents; the least z-value and the least log-odds, either way, below which a token counts as 0; and the fewest documents of the kind it speaks for.
PRIOR, EVIDENCE, LEAST_ODDS, FEWEST = 4.0, 2.0, 1.0, 4
#: Beginnings of words of these lengths are tokens of their own.
BEGINNINGS = (4, 5, 6)
#: What each word adds besides its log-odds; below 0, so that a segment must gain by every word it takes in and sums of clean texts stay bounded.
DRIFT = -0.25
#: Tokens that a task counts before it hands the counts on.
HELD_TOKENS = 50_000
#: Distinct words whose weights a task keeps before it starts anew; this bounds memory and changes no result.
MEMO = 400_000

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def tokens_of(word: str) -> list[str]:
    """The word and its beginnings; the mark tells a beginning from a word."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) >= k)]


def segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal segments (first word, last word, sum) of a text whose words with log-odds are given.

    Each word adds drift besides. One pass with a stack of candidates, each with
    the running sum before and after it; a candidate is merged leftwards while
    an earlier one begins lower and ends below it. Each keeps the place of the
    nearest earlier one that begins lower, so that searches skip what an earlier
    search has passed and the whole takes linear time.
    """
    stack: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, -1
    for i, s in scores:
        total += drift * (i - at - 1)
        at = i
        left, right, first, last = total, total + s + drift, i, i
        total = right
        if right <= left:
            continue
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, last, left, right, j))
    return [(a, b, r - x) for a, b, x, r, _ in stack]


@dataclass
class Model:
    """Weights of tokens, the extreme-value fit of clean texts and the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    place: float = 0.0
    spread: float = 1.0
    a: float = 0.0
    b: float = -50.0
    _memo: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, word: str) -> float:
        got = self._memo.get(word)
        if got is None:
            if len(self._memo) > MEMO:
                self._memo.clear()
            known = [self.weights[t] for t in tokens_of(word) if t in self.weights]
            got = self._memo[word] = max(known, key=abs) if known else 0.0
        return got

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """How many words a text has, and its segments."""
        words = words_of(text)
        # set() and the memo see each word once; most texts have no word of weight.
        heavy = {w for w in set(words) if self.weight(w)} if self.weights else ()
        return len(words), segments([(i, self.weight(w)) for i, w in enumerate(words) if w in heavy]) if heavy else []

    def surprise(self, n: int, s: float) -> float:
        """-ln of the chance that a clean text of n words has a segment of sum s."""
        z = (s - self.slope * math.log1p(n) - self.place) / self.spread
        if z > 30:
            return z
        return -math.log(-math.expm1(-math.exp(-max(z, -5.0))))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Surprise of the best passage, and a share of that of the other significant ones."""
        each = sorted((self.surprise(n, s) for _, _, s in found), reverse=True)
        return min(100.0, each[0] + 0.25 * sum(x for x in each[1:] if x > 3)) if each else 0.0

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.a * evidence + self.b, -50.0), 50.0)))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, left_out: int = 0, bound: int = TRAIN_ROWS) -> Model:
    """Fits on labelled rows whose crc32(doc_id as text) mod modulus isn't left_out."""
    spark = docs.sparkSession
    rows = training_rows(docs, labels, "toxic", modulus, left_out, bound)

    def lots(batches):
        for batch in batches:
            for part in rows_of(batch):
                sets = shingle_sets(*text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([int(h[0].astype(np.int64)) if len(h) else 0 for h in sets], pa.int64())], names=["doc_id", "text", "y", "lot"])
            trim()

    # Rows that share their smallest 5-word shingle are mostly copies; the smallest id of each lot stays, and one row of each id.
    train = stage_table(rows.mapInArrow(lots, "doc_id long, text string, y double, lot long").withColumn("row", F.monotonically_increasing_id()), "toxicity")
    each = train.groupBy("doc_id").agg(F.min(F.struct("lot", "row", "y")).alias("x")).select("doc_id", "x.*")
    first = each.groupBy("lot", "y").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("x.row")  # at most bound rows
    own = stage_table(train.join(F.broadcast(first), "row").select("y", "text").repartition(FIT_PARTITIONS), "toxicity-train")
    release(spark, train)
    count = {r[0]: r[1] for r in own.groupBy((F.col("y") > 0).alias("toxic")).count().collect()}
    if len(count) < 2:
        release(spark, own)
        return Model()

    def tally(batches):
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def out():
            keys = list(seen)
            counts = np.array([seen[k] for k in keys], np.int64).reshape(-1, 2)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["token", "clean", "toxic"])

        for batch in batches:
            for part in rows_of(batch):
                for y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for t in {t for word in set(words_of(text)) for t in tokens_of(word)}:
                        seen[t][y > 0] += 1
                    if len(seen) >= HELD_TOKENS:
                        yield out()
        yield out()
        trim()

    n_clean, n_toxic = float(count[False]), float(count[True])
    sums = own.mapInArrow(tally, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # An informative Dirichlet prior: as if PRIOR more documents of either kind held the token as often as all do.
    prior = PRIOR * (F.col("clean") + F.col("toxic")) / (n_clean + n_toxic)
    odds = lambda k, n: F.log((k + prior) / (n + PRIOR - k - prior))
    best = (
        sums
        .withColumn("weight", odds(F.col("toxic"), n_toxic) - odds(F.col("clean"), n_clean))
        .withColumn("z", F.col("weight") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)))
        .where((F.abs("z") >= EVIDENCE) & (F.abs("weight") >= LEAST_ODDS))
        .where(((F.col("weight") > 0) & (F.col("toxic") > F.col("clean")) & (F.col("toxic") >= FEWEST)) | ((F.col("weight") < 0) & (F.col("clean") >= FEWEST)))
    )
    model = Model(weights={r["token"]: float(r["weight"]) for r in best.select("token", "weight").collect()})

    def measure(batches):
        for y, texts in _parts(batches):
            n, s = zip(*((n, max((x[2] for x in f), default=0.0)) for n, f in map(model.passages, texts.to_pylist())), strict=True)
            yield pa.RecordBatch.from_arrays([y, pa.array(n, pa.float64()), pa.array(s, pa.float64())], names=["y", "n", "s"])

    clean = np.array([r for r in own.where("y <= 0").mapInArrow(measure, "y double, n double, s double").collect()])  # at most bound rows
    x, s = np.log1p(clean[:, 1]), clean[:, 2]
    if x.std() > 0:
        model.slope = max(0.0, float(np.cov(x, s)[0, 1] / x.var()))
    rest = s - model.slope * x
    # Method of moments for Gumbel's law; never sharper than one unit of log-odds.
    model.spread = max(1.0, float(rest.std()) * math.sqrt(6) / math.pi)
    model.place = float(rest.mean()) - 0.5772156649 * model.spread

    def weigh(batches):
        for y, texts in _parts(batches):
            e = [model.evidence(*model.passages(t)) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([y, pa.array(e, pa.float64())], names=["y", "e"])

    pairs = np.array(own.mapInArrow(weigh, "y double, e double").collect())  # at most bound rows
    release(spark, own)
    model.a, model.b = logistic(pairs[:, 1], (pairs[:, 0] > 0).astype(float))
    return model


def _parts(batches):
    """(first column, texts) of slices of batches of two columns."""
    for batch in batches:
        for part in rows_of(batch):
            yield part.column(0), part.column(1)
        trim()


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge; the slope is never below 0."""
    scale = x.std() or 1.0
    z = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2), z.T @ (y - p) - 0.01 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0] / scale)), float(w[1])


def score_documents(docs: DataFrame, model: Model, modulus: int = 5, left_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, and the passages: n_passages, best_first and best_last word."""

    def run(batches):
        for ids, texts in _parts(batches):
            out = []
            for text in texts.to_pylist():
                n, found = model.passages(text)
                best = max(found, key=lambda x: x[2], default=(None, None, 0.0))
                out.append((model.score(model.evidence(n, found)), sum(model.surprise(n, x[2]) > 3 for x in found), best[0], best[1]))
            score, n, first, last = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([ids, pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["doc_id", "score", "predicted", "n_passages", "best_first", "best_last"])

    scored = texts_of(docs, "doc_id").mapInArrow(run, "doc_id long, score double, predicted int, n_passages long, best_first long, best_last long")
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == left_out, F.lit(False)).alias("held_out"), "score", "predicted", "n_passages", "best_first", "best_last")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns, whatever their names; a null text counts as empty, repeated rows are each decided."""
    return keep_where(docs, lambda texts: pa.array([model.score(model.evidence(*model.passages(t))) < 0.5 for t in texts.to_pylist()], pa.bool_()))
