"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.  The
votes of the whole corpus are counted per pattern (at most 3 to the number of
labellers, whatever the corpus); expectation-maximisation on these counts
estimates each labeller's accuracy per class and the class shares.  The posterior of each
pattern labels a bounded sample of documents, on which a linear scorer over hashed
words and word shapes is trained.  The scorer reads every whole text.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .pretokens import per_worker

SLOTS = 1 << 16
#: Upper case, lower case and digits stand for themselves as a class; bytes of other scripts count as letters.
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 if c <= 32 else c for c in range(256))
GOOD, BAD, ABSTAIN = "g", "b", "-"


class Facts:
    """Counts of one text that the labellers look at."""

    def __init__(self, text: str):
        raw = text.encode("utf-8")
        shape = raw.translate(SHAPE)
        self.words = raw.lower().split()
        self.n = len(self.words)
        self.upper, self.lower, self.digits, self.space = (shape.count(c) for c in (b"A", b"a", b"0", b" "))
        self.plain = sum(shape.count(c) for c in (b".", b",", b"'", b"-", b";", b":", b"?", b'"'))
        self.bytes = len(raw)
        self.lines = [x for x in text.split("\n") if x.strip()]
        self.ended = sum(x.rstrip()[-1] in ".!?\"'" for x in self.lines)
        self.counts = Counter(self.words)
        a = np.frombuffer(shape, dtype=np.uint8)
        keep = np.ones(len(a), dtype=bool)
        keep[1:] = (a[1:] != a[:-1]) | (a[1:] == 32)
        self.shapes = Counter(a[keep].tobytes().split())


def between(value: float, bad_below: float, good_from: float) -> str:
    """Bad below the first bound, good from the second on (swap signs for upper bounds)."""
    return BAD if value < bad_below else GOOD if value >= good_from else ABSTAIN


def symbols(f: Facts) -> str:
    odd = f.bytes - f.upper - f.lower - f.digits - f.space - f.plain
    return between(-odd / max(1, f.bytes), -0.06, -0.02)


def capitals(f: Facts) -> str:
    return between(-f.upper / max(1, f.upper + f.lower), -0.4, -0.15)


def letters(f: Facts) -> str:
    return between((f.upper + f.lower) / max(1, f.bytes - f.space), 0.8, 0.92)


def endings(f: Facts) -> str:
    return between(f.ended / max(1, len(f.lines)), 0.2, 0.7)


def variety(f: Facts) -> str:
    return ABSTAIN if f.n < 40 else between(len(f.counts) / f.n ** 0.75, 0.6, 1.2)


def dominance(f: Facts) -> str:
    return ABSTAIN if f.n < 20 else between(-max(f.counts.values()) / f.n, -0.2, -0.1)


def word_length(f: Facts) -> str:
    mean = sum(map(len, f.words)) / max(1, f.n)
    return GOOD if 3.5 <= mean <= 9 else BAD if mean < 2.5 or mean > 14 else ABSTAIN


def runs(f: Facts) -> str:
    """Words following an equal word."""
    return ABSTAIN if f.n < 10 else between(-sum(a == b for a, b in zip(f.words, f.words[1:], strict=False)) / f.n, -0.15, -0.03)


LABELLERS: tuple[Callable[[Facts], str], ...] = (symbols, capitals, letters, endings, variety, dominance, word_length, runs)


def hashed(f: Facts) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights (square roots of counts, length one) of words and of word shapes."""
    keys = [crc32(w) % SLOTS for w in f.counts] + [crc32(b"\x00" + s) % SLOTS for s in f.shapes]
    weight = np.concatenate([_unit(f.counts), _unit(f.shapes)]) / np.sqrt(2)
    return np.array(keys, dtype=np.int64), weight


def _unit(counts: Counter) -> np.ndarray:
    x = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    return x / max(1e-12, np.linalg.norm(x))


def accuracies(patterns: dict[str, int], rounds: int = 200) -> tuple[np.ndarray, dict[str, float]]:
    """EM over vote patterns: P(vote good | not abstaining, class) per labeller and class (bad, good),
    and the posterior of the good class per pattern."""
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], dtype=np.float64)
    votes = np.array([[{GOOD: 1, BAD: 0}.get(v, -1) for v in k] for k in keys], dtype=np.int64).reshape(len(keys), len(keys[0]) if keys else 0)
    good, bad = votes == 1, votes == 0
    rate = np.tile([[0.3], [0.9]], (1, votes.shape[1])) if len(keys) else np.zeros((2, 0))
    share = 0.8
    posterior = np.full(len(keys), share)
    for _ in range(rounds):
        like = [np.log(rate[c]) @ good.T + np.log1p(-rate[c]) @ bad.T for c in (0, 1)]
        posterior = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)) * (1 - share) / share)
        for c, p in enumerate((1 - posterior, posterior)):
            w = n * p
            rate[c] = np.clip((w @ good + 1) / (w @ (good | bad) + 2), 1e-3, 1 - 1e-3)
        share = float(np.clip((n @ posterior) / max(1.0, n.sum()), 0.01, 0.99))
    return rate, dict(zip(keys, posterior.tolist(), strict=True))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], passes: int = 20, rate: float = 2.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by seeded stochastic gradient steps."""
    w, b, rng, step = np.zeros(SLOTS), 0.0, np.random.default_rng(42), 0
    for _ in range(passes):
        for k in rng.permutation(len(rows)):
            at, x, target = rows[k]
            error = target - 1 / (1 + np.exp(-np.clip(w[at] @ x + b, -30, 30)))
            size = rate / (1 + step / (5.0 * max(1, len(rows))))
            np.add.at(w, at, size * error * x)
            b += 0.05 * size * error
            step += 1
        w *= 1 - decay
    return w, b


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            sample_docs: int = 4000, sample_bytes: int = 1 << 16) -> DataFrame:
    """``id``, ``votes`` (one letter per labeller), ``posterior`` of the label model, ``score`` of the trained
    scorer (0 to 1, good is high) and ``keep`` (score of at least 0.5) per input row.

    The label model counts all documents; the scorer is fitted on a bounded sample: about
    ``sample_docs`` of them, chosen by the hash of id and text among those of at most
    ``sample_bytes`` bytes, and put in the order of that hash, so that the layout of the table
    doesn't matter.  Edge cases: null and empty texts have no words, are voted on
    like any other and score 0; a very long text is voted on and scored whole; a score of exactly
    0.5 is kept; repeated rows give repeated results; a null id stays null; extra columns of any name
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    @F.pandas_udf("string")
    def vote(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            facts = Facts(t or "")
            out.append("".join(label(facts) for label in LABELLERS))
        return pd.Series(out, dtype="object")

    voted = materialise(rows.select("id", vote("text").alias("votes")), "votes")
    patterns = {r.votes: r["count"] for r in voted.groupBy("votes").count().orderBy("votes").collect()}
    _, posterior = accuracies(patterns)
    total = sum(patterns.values())
    model, bias = np.zeros(SLOTS), 0.0
    if total:
        span, place = 1 << 31, F.pmod(F.xxhash64("id", "text"), F.lit(1 << 31))
        sample = rows.where("text <> ''").where(F.octet_length("text") <= sample_bytes).select(place.alias("place"), "text").where(
            F.col("place") < int(span * min(1.0, sample_docs / total)))

        def taught(batches):
            for batch in batches:
                out = []
                for place, t in zip(batch["place"], batch["text"], strict=True):
                    facts = Facts(t)
                    at, x = hashed(facts)
                    out.append((place, at, x, posterior["".join(label(facts) for label in LABELLERS)]))
                yield pd.DataFrame(out, columns=["place", "at", "x", "target"])

        picked = sample.mapInPandas(taught, "place long, at array<long>, x array<double>, target double").collect()
        picked.sort(key=lambda r: (r.place, r.at, r.x))
        model, bias = train([(np.array(r.at), np.array(r.x), r.target) for r in picked])
    shared, key = spark.sparkContext.broadcast((model, bias, posterior)), uuid.uuid4().hex

    @F.pandas_udf("votes string, posterior double, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        w, b, known = per_worker(key, lambda: shared.value)
        out = []
        for t in texts:
            facts = Facts(t or "")
            votes = "".join(label(facts) for label in LABELLERS)
            at, x = hashed(facts)
            out.append((votes, known[votes], float(1 / (1 + np.exp(-(w[at] @ x + b)))) if facts.n else 0.0))
        return pd.DataFrame(out, columns=["votes", "posterior", "score"])

    return rows.select("id", judge("text").alias("out")).select("id", "out.*").withColumn("keep", F.col("score") >= 0.5)
