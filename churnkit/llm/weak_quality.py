"""Quality classifier from weak labels.

Overlapping heuristic labellers look at the whole text and vote bad, good or not
at all; each is meant for one kind of bad document, and each kind has at least two.
Expectation-maximisation over the counts of vote patterns of all documents
estimates how often each labeller votes bad on good documents and on each kind of
bad ones (no ground truth is read); the posterior of a document's pattern is its
soft label.  A linear scorer over hashed features learns these labels and scores
every document.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import as_bytes, batch, fresh, materialise, text_of

#: the scorer is fitted on the documents with the smallest hashes, so many at most
FIT_ROWS = 4096
DIMS = 1 << 12  # hashed byte trigrams; DIMS and DIMS + 1 are the share of repeated words and of repeated lines
ABSTAIN, BAD, GOOD = 0, 1, 2
SIGNS = rb"#$%&*|<>{}~^\\"
SIGN_RUNS = re.compile(rb"[" + SIGNS + rb"]{2,}")
NOT_SIGNS = bytes(b for b in range(256) if not re.match(rb"[" + SIGNS + rb"]", bytes([b])))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
BLOCK = 50  # words
#: the kinds of bad documents that the labellers look for, in the order of ``votes``
KINDS = ("signs", "signs", "tables", "tables", "shouting", "shouting", "shouting", "repetition", "repetition", "repetition", "blank", "blank")
N_LABELLERS = len(KINDS)


def _vote(known: bool, value: float, good: float, bad: float) -> int:
    """BAD above ``bad``, GOOD up to ``good``, no vote between them or if the text doesn't show the value."""
    return ABSTAIN if not known else BAD if value > bad else GOOD if value <= good else ABSTAIN


def measures(text: bytes) -> tuple[list[bytes], float, float]:
    """Words, share of words equal to the one before, share of lines that occurred before."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in pairwise(words)) / max(1, len(words) - 1)
    return words, same, 1 - len(set(lines)) / len(lines) if lines else 0.0


def votes(text: bytes) -> list[int]:
    """One vote of each labeller on a whole text."""
    words, same, lines = measures(text)
    n = len(words)
    some = max(1, n)
    up, low = len(text) - len(text.translate(None, UPPER)), len(text) - len(text.translate(None, LOWER))
    letters = up + low
    blocks = [words[k:k + BLOCK] for k in range(0, n, BLOCK) if n - k >= BLOCK // 2]
    told = sum(len(set(x)) for x in blocks) / max(1, sum(map(len, blocks)))
    wordlike = text.translate(None, MARKS + b" \t\n\r\x0b\x0c")
    return [
        _vote(n >= 5, len(text.translate(None, NOT_SIGNS)) / some, 0.02, 0.1),
        _vote(n >= 5, len(SIGN_RUNS.findall(text)) / some, 0.01, 0.1),
        _vote(n >= 5, text.count(b"|") / some, 0.01, 0.1),
        _vote(n >= 20, sum(not w.strip(MARKS) for w in words) / some, 0.02, 0.1),
        _vote(letters >= 20, up / max(1, letters), 0.15, 0.3),
        _vote(n >= 5, sum(len(w) > 2 and w.isupper() for w in words) / some, 0.05, 0.2),
        _vote(n >= 5, (text.count(b"!") + text.count(b"?")) / some, 0.05, 0.2),
        _vote(n >= 5, same, 0.05, 0.2),
        _vote(bool(blocks), 1 - told, 0.4, 0.6),
        _vote(text.count(b"\n") >= 4, lines, 0.2, 0.8),
        BAD if n == 0 else ABSTAIN,
        BAD if not wordlike else ABSTAIN,
    ]


#: what is believed of a labeller before any data, as so many votes: (bad votes, good votes)
ON_GOOD, ON_OWN, ON_OTHER = (0.2, 9.8), (7.0, 3.0), (1.0, 9.0)


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, kinds: Sequence[str] = KINDS, rounds: int = 1000,
                  until: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over distinct vote patterns: (posterior of good by pattern, P(bad vote | a vote, class) [labeller, class], class shares).

    Class 0 is good; each kind of bad documents is a class of its own, since kinds
    hardly overlap: a class of all bad documents would look like the largest kind.
    Votes are independent given the class, and whether a labeller votes at all
    says nothing (an abstention is missing data).  All error rates are estimated.
    What tells the classes apart is a belief of ten votes per rate: a labeller
    mostly votes bad on its own kind and seldom on others; and the start,
    where a document is of a kind as far as that kind's labellers agree.  With
    thousands of documents ten votes weigh nothing: a labeller that errs on many
    good documents is found out by the others of its kind and is outvoted.
    """
    names = list(dict.fromkeys(kinds))
    own = np.array([[k == name for name in names] for k in kinds])  # labeller, kind
    bad, voted = (patterns == BAD).astype(float), (patterns != ABSTAIN).astype(float)
    share = (bad @ own) / np.maximum(voted @ own, 1)
    start = np.concatenate([np.prod(1 - share, axis=1, keepdims=True), share ** 2], axis=1)
    post = start / start.sum(axis=1, keepdims=True)
    belief = np.where(own[..., None], ON_OWN, ON_OTHER)  # labeller, kind, (bad, good)
    belief = np.concatenate([np.broadcast_to(np.array(ON_GOOD), (len(kinds), 1, 2)), belief], axis=1)
    rate, prior = np.zeros(belief.shape[:2]), np.zeros(len(names) + 1)
    for _ in range(rounds):
        weight = post * counts[:, None]
        prior = (weight.sum(axis=0) + 1) / (counts.sum() + len(names) + 1)
        yes, all_ = bad.T @ weight, voted.T @ weight
        rate = (yes + belief[..., 0]) / (all_ + belief.sum(axis=2))
        logs = np.log(prior) + bad @ np.log(rate) + (voted - bad) @ np.log(1 - rate)
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved = np.abs(new - post).max()
        post = new
        if moved < until:
            break
    return post[:, 0], rate, prior


def bins(text: bytes) -> np.ndarray:
    """Hashed bin of every byte trigram."""
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, dtype=np.int64)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)


def features(text: bytes) -> np.ndarray:
    """Roots of trigram frequencies (so that no frequent trigram rules the sum), then the shares of repeated words and lines."""
    out = np.zeros(DIMS + 2, dtype=np.float32)
    at = bins(text)
    if len(at):
        out[:DIMS] = np.sqrt(np.bincount(at, minlength=DIMS) / len(at))
    out[DIMS:] = measures(text)[1:]
    return out


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 1000, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels (classes weighed alike) by accelerated gradient steps: (weights, bias)."""
    scale = np.sqrt((x ** 2).mean(0)) + 1e-4
    z = x / scale
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    good = max(1e-6, float(y.mean()))
    if len(y) < 2 or not 1e-4 < good < 1 - 1e-4:
        return w, float(np.log(good / max(1e-6, 1 - good)))
    weight = y / good + (1 - y) / (1 - good)
    step = 4.0 / max(1.0, float((z ** 2).sum(1).mean())) / 2
    v, vb = w.copy(), 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ v + vb, -30, 30)))
        r = ((p - y) * weight / 2).astype(np.float32)
        new, nb = v - step * (z.T @ r / len(y) + penalty * v), vb - step * float(r.mean())
        m = t / (t + 3)
        v, vb, w, b = new + m * (new - w), nb + m * (nb - b), new, nb
    return w / scale, b


def score(text: bytes, w: np.ndarray, b: float) -> float:
    z = b + float(features(text) @ w)
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


NAMES = ("weak_label", "quality_score", "quality_keep")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS,
             threshold: float = 0.5, names: Sequence[str] = NAMES) -> DataFrame:
    """``docs`` with columns weak_label (posterior of good from the votes), quality_score and quality_keep added.

    Null text counts as empty, which only the labellers of blank texts vote on,
    and scores by the bias; null ids, repeated rows and other columns pass through.
    ``names`` are the names of the three columns; existing columns of these names
    are replaced.  An empty table gives an empty result.  The scorer
    is fitted on ``fit_rows`` documents at most, those with the smallest hash of
    id and text; votes, patterns and scores cover all documents.
    """
    spark = docs.sparkSession
    src = docs.select(F.xxhash64(F.col(id_col).cast("string"), text_of(text_col)).alias("h"), text_of(text_col).alias("text"))
    out = pa.schema([("h", pa.int64()), ("pattern", pa.int64())])

    def cast_votes(batches):
        for b in batches:
            codes = [sum(v * 3 ** j for j, v in enumerate(votes(t))) for t in as_bytes(b.column("text"))]
            yield batch(out, b.column("h"), codes)

    voted = materialise(src.mapInArrow(cast_votes, "h long, pattern long"), "votes")
    seen = voted.groupBy("pattern").count().toPandas()  # 3 ** labellers rows at most
    codes, counts = seen["pattern"].to_numpy(dtype=np.int64), seen["count"].to_numpy(dtype=float)
    patterns = codes[:, None] // 3 ** np.arange(N_LABELLERS) % 3
    good, _, _ = fit_labellers(patterns, counts) if len(codes) else (np.empty(0), None, 0.5)
    posterior = dict(zip(codes.tolist(), good.tolist()))

    # the texts of the sample: ``fit_rows`` hashes, then one pass for their features
    low = voted.select("h").distinct().orderBy("h").limit(fit_rows)
    part = pa.schema([("pattern", pa.int64()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def featurise(batches):
        for b in batches:
            x = [features(t) for t in as_bytes(b.column("text"))]
            at = [np.flatnonzero(f) for f in x]
            codes = [sum(v * 3 ** j for j, v in enumerate(votes(t))) for t in as_bytes(b.column("text"))]
            yield batch(part, codes, [a.astype(np.int32) for a in at], [f[a] for f, a in zip(x, at)])

    bound = low.agg(F.max("h")).first()[0]
    sample = (src.where(F.col("h") <= F.lit(bound if bound is not None else 0)).dropDuplicates(["h"])
              .mapInArrow(featurise, "pattern long, at array<int>, value array<float>").toPandas())
    x, y = np.zeros((len(sample), DIMS + 2), dtype=np.float32), np.zeros(len(sample))
    for k, (code, at, value) in enumerate(sample.itertuples(index=False)):
        x[k, at], y[k] = value, posterior[code]
    w, bias = fit_scorer(x, y) if len(sample) else (np.zeros(DIMS + 2, dtype=np.float32), 0.0)
    model = spark.sparkContext.broadcast((w, bias, posterior))  # DIMS weights and 3 ** labellers posteriors

    cols = [c for c in docs.columns if c.lower() not in {x.lower() for x in names}]
    full = docs.select(*[F.col(f"`{c}`") for c in cols])

    def run(batches):
        w, bias, posterior = model.value
        for b in batches:
            texts = as_bytes(b.column(b.num_columns - 1))
            weak = [posterior.get(sum(v * 3 ** j for j, v in enumerate(votes(t))), 0.5) for t in texts]
            s = np.array([score(t, w, bias) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(b.num_columns - 1)], pa.array(weak, pa.float64()), pa.array(s, pa.float64()), pa.array(s >= threshold)],
                names=[*cols, *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema],
                        *[f"`{c}` {kind}" for c, kind in zip(names, ("double", "double", "boolean"))]])
    return full.withColumn(fresh(full, "text for scoring")[0], text_of(text_col)).mapInArrow(run, schema)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, all columns with their values.

    Columns that are named like the classifier's own keep their values.  Null ids
    and repeated rows are judged by their text like all others, so equal texts
    stay or go together; null and empty texts go where blank texts are seen to be
    bad; an empty table stays empty.
    """
    names = fresh(docs, *NAMES)
    return classify(docs, id_col, text_col, names=names, **options).where(F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])
