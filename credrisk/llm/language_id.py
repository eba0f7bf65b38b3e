"""Language ID by cross-parsing entropy.

A suffix automaton of a bounded sample of labelled text is built per language.  A
text is cross-parsed against each: it is cut greedily into the longest phrases
that occur in the language's sample.  A phrase costs log2(size of the largest sample)
bits and a byte that the sample never holds eight more; the sum over the text's bytes
estimates the cross entropy in bits a byte; the language with the smallest value wins.
All languages pay the same, so that a small sample is never a cheap one.

The automata are laid out as one dense transition table (state x byte class), in
which a missing transition leads to the state of a new phrase and carries a flag.
Workers parse all blocks of a batch in lockstep with one gather per byte position.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .pretokens import per_worker

BLOCK = 512          # bytes parsed before a new phrase is begun
LOCKSTEP = 4096      # blocks parsed together
WORD_CHARACTER = re.compile(r"[^\W\d_]")   # letters, and numbers such as ½ or Ⅷ
UNSEEN_BITS = 8.0    # on top of a phrase, for a byte that a sample never holds
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether a character of category L occurs (as ``\\p{L}`` in Spark)."""
    return any(unicodedata.category(m[0])[0] == "L" for m in WORD_CHARACTER.finditer(text))


def suffix_automaton(texts: list[bytes]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of the texts; state 0 is the root."""
    edges, link, length = [{}], [-1], [0]

    def state(out: dict[int, int], size: int, suffix: int) -> int:
        edges.append(out)
        length.append(size)
        link.append(suffix)
        return len(edges) - 1

    for text in texts:
        last = 0
        for c in text:
            p, q = last, edges[last].get(c)
            if q is not None and length[q] == length[p] + 1:
                last = q
                continue
            new = state({}, length[p] + 1, 0) if q is None else -1
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                target = q
                if length[q] != length[p] + 1:
                    target = state(dict(edges[q]), length[p] + 1, link[q])
                    link[q] = target
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = target
                        p = link[p]
                if new >= 0:
                    link[new] = target
                else:
                    new = target
            last = new
    return edges


@dataclass
class Model:
    """Languages, one flat table over (state, byte class) holding next * 2 + flag, and its lay-out;
    bits of a phrase, and bits of each byte value by language (more than 0 where its sample lacks it)."""

    languages: list[str]
    roots: np.ndarray
    weight: float
    unseen: np.ndarray
    table: np.ndarray
    classes: np.ndarray
    width: int

    @classmethod
    def build(cls, samples: dict[str, list[bytes]]) -> Model:
        languages = sorted(samples)
        seen = sorted({b for texts in samples.values() for t in texts for b in t})
        pad, unknown, width = len(seen), len(seen) + 1, len(seen) + 2
        classes = np.full(256, unknown, dtype=np.uint8 if width <= 256 else np.uint16)
        classes[seen] = np.arange(len(seen))
        unseen = np.full((256, len(languages)), UNSEEN_BITS)
        tables, roots, offset = [], [], 0
        for k, lang in enumerate(languages):
            edges = suffix_automaton(samples[lang])
            first = np.full(width, offset * 2 + 1, dtype=np.int32)
            for b, q in edges[0].items():
                first[classes[b]] = (offset + q) * 2 + 1
            rows = np.tile(first, (len(edges), 1))
            rows[:, pad] = (offset + np.arange(len(edges))) * 2
            for s, out in enumerate(edges):
                for b, q in out.items():
                    rows[s, classes[b]] = (offset + q) * 2
            tables.append(rows)
            roots.append(offset)
            unseen[list(edges[0]), k] = 0
            offset += len(edges)
        weight = math.log2(max([2, *(sum(map(len, texts)) for texts in samples.values())]))
        table = np.concatenate(tables).ravel() if tables else np.zeros(0, dtype=np.int32)
        return cls(languages, np.array(roots, dtype=np.int32), weight, unseen, table, classes, width)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrase counts, one row per text and one column per language."""
        blocks = [-(-len(t) // BLOCK) for t in texts]
        ends = np.cumsum(blocks)
        total = int(ends[-1]) if texts else 0
        codes = np.full(total * BLOCK, self.width - 2, dtype=self.classes.dtype)
        for t, end, n in zip(texts, ends.tolist(), blocks, strict=True):
            at = (end - n) * BLOCK
            codes[at:at + len(t)] = self.classes[np.frombuffer(t, dtype=np.uint8)]
        grid = codes.reshape(total, BLOCK)
        counts = np.empty((total, len(self.languages)), dtype=np.int64)
        for lo in range(0, total, LOCKSTEP):
            part = np.ascontiguousarray(grid[lo:lo + LOCKSTEP].T)
            state = np.repeat(self.roots[:, None], part.shape[1], axis=1).astype(np.int64)
            breaks = np.zeros(state.shape, dtype=np.int32)
            for column in part:
                state *= self.width
                state += column
                step = self.table.take(state)
                breaks += step & 1
                np.right_shift(step, 1, out=state, casting="unsafe")
            counts[lo:lo + LOCKSTEP] = breaks.T + 1
        sums = np.concatenate([np.zeros((1, len(self.languages)), dtype=np.int64), np.cumsum(counts, axis=0)])
        return sums[ends] - sums[ends - np.array(blocks, dtype=np.int64)]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Bits to write the texts, one row per text and one column per language."""
        held = np.array([np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256) for t in texts]).reshape(len(texts), 256)
        return self.phrases(texts) * self.weight + held @ self.unseen

    def predict(self, texts: list[str | None], batch_bytes: int = 2 << 20) -> list[tuple[str, float]]:
        """(language, score) per text; the score is one minus best over second-best entropy."""
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        pending: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            bits = self.bits([t for _, t in pending])
            best = bits.argmin(axis=1)
            for row, (k, _), b in zip(bits, pending, best.tolist(), strict=True):
                rest = np.delete(row, b)
                out[k] = (self.languages[b], float(1 - row[b] / rest.min()) if len(rest) else 1.0)

        for k, text in enumerate(texts):
            if not self.languages or not text or not has_letter(text):
                continue
            pending.append((k, text.lower().encode("utf-8")))
            size += len(pending[-1][1])
            if size >= batch_bytes:
                flush()
                pending, size = [], 0
        if pending:
            flush()
        return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        docs_per_language: int = 48, bytes_per_language: int = 16_384, max_total_bytes: int = 1 << 18) -> Model:
    """Build the automata from a bounded, seeded sample of the labelled rows.

    At most ``docs_per_language`` documents per language (smallest hashes of their ids) give one
    piece each, from a place that the hash chooses anywhere in the text, so that openings and
    footers which many texts share don't stand for the language; equal pieces count once.  The pieces of a
    language have ``bytes_per_language`` bytes at most, and those of all languages
    ``max_total_bytes``, which bounds the broadcast table: with more than ``max_total_bytes /
    bytes_per_language`` languages each gets an equal share of it.  Rows with a null id, text or
    language and texts without letters teach nothing.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        "id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(7)), "id")
    # written: its few rows are then known to be few, and the join need not shuffle the texts
    chosen = materialise(rows.select("id", "lang").withColumn("k", F.row_number().over(order)).where(
        F.col("k") <= docs_per_language).select("id", "lang").distinct(), "language-sample")
    share = max(1, bytes_per_language // docs_per_language)
    room = F.greatest(F.length("text") - share, F.lit(0)) + 1
    piece = F.substr("text", (F.pmod(F.xxhash64("id", "text", F.lit(11)), room) + 1).cast("int"), F.lit(share))
    picked = rows.join(chosen, ["id", "lang"]).select("lang", "id", piece.alias("piece"))
    order = Window.partitionBy("lang").orderBy("id", "piece")
    picked = picked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_language).orderBy("lang", "k")
    samples: dict[str, list[bytes]] = {}
    for r in picked.collect():
        samples.setdefault(r.lang, []).append(r.piece.lower().encode("utf-8"))
    limit = min(bytes_per_language, max_total_bytes // max(1, len(samples)))
    for lang, pieces in samples.items():
        kept, left, pieces = [], limit, sorted(set(pieces), key=lambda t: (len(t), t))
        for k, t in enumerate(pieces):
            kept.append(t[:left // (len(pieces) - k)])
            left -= len(kept[-1])
        samples[lang] = kept
    return Model.build(samples)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred`` and ``score`` (0 to 1) per input row, from the whole text only.

    Edge cases: a null text, an empty one and one without letters give ``und`` and
    score 0, as does every text if nothing was learned; with one language the
    score is 1; ties go to the first name; repeated rows give repeated results; a very
    long text is parsed whole, in blocks; extra columns of any name are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(per_worker(key, lambda: shared.value).predict(texts.tolist()), columns=["lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), predict(F.col(text_col)).alias("out")).select("id", "out.*")
