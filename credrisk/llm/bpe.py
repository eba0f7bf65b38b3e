"""BPE encoding and decoding: speculate, verify, and merge exactly only where that fails.

For every pre-token a worker has not seen, greedy longest match proposes tokens.
A sequence of tokens is the BPE encoding of its bytes exactly if every adjacent
pair is the encoding of its own two tokens, so one vectorised pass over all new
words of a batch checks the distinct adjacent pairs (known pairs are remembered)
and marks the words that hold an incompatible one.  Only those are merged exactly,
by the library's model.  The job is one map over the documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PreTokenizer, per_worker


class Codec:
    """Encodes pre-tokens in batches and decodes ids; caches both per worker."""

    def __init__(self, spec: str, cache_size: int):
        self.cutter = PreTokenizer(spec)
        back = {c: b for b, c in self.cutter.alphabet.items()}
        self.ids = {bytes(map(back.__getitem__, t)): i for t, i in self.cutter.vocab.items()}
        self.octets = {i: t for t, i in self.ids.items()}
        self.longest: dict[bytes, int] = {}  # by the first two bytes
        for t in self.ids:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 0), len(t))
        self.names = {i: t for t, i in self.cutter.vocab.items()}
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, tuple[str, int, str]] = {}
        self.limit = cache_size
        self.failed = self.proposed = 0

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match over the vocabulary (every single byte is a token)."""
        out, pos, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while pos < n:
            end = min(n, pos + longest.get(word[pos:pos + 2], 1))
            while (token := ids.get(word[pos:end])) is None:
                end -= 1
            out.append(token)
            pos = end
        return out

    def compatible(self, code: int) -> bool:
        """Whether the two tokens of the pair encode to themselves when joined."""
        known = self.pairs.get(code)
        if known is None:
            a, b = divmod(code, 1 << 32)
            got = [t.id for t in self.cutter.tokenizer.model.tokenize(self.names[a] + self.names[b])]
            if len(self.pairs) >= 2_000_000:
                self.pairs.clear()
            known = self.pairs[code] = got == [a, b]
        return known

    def encode_words(self, words: list[str]) -> list[list[int]]:
        proposals = [self.propose(w.encode("utf-8")) for w in words]
        flat = np.array([t for p in proposals for t in p], dtype=np.int64)
        word_of = np.repeat(np.arange(len(words)), [len(p) for p in proposals])
        inner = word_of[1:] == word_of[:-1]
        codes, which = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
        bad = ~np.array([self.compatible(c) for c in codes.tolist()], dtype=bool)
        failing = np.unique(word_of[1:][inner][bad[which]]) if len(codes) else []
        self.proposed += len(words)
        self.failed += len(failing)
        for k in failing:
            proposals[k] = self.cutter.exact(words[k])
        return proposals

    def learn(self, words: list[str]) -> None:
        """Make sure that every word of a piece is in the cache."""
        new = list(set(words).difference(self.cache))
        if not new:
            return
        if len(self.cache) + len(new) > self.limit:
            self.cache.clear()
            new = list(set(words))
        for word, ids in zip(new, self.encode_words(new), strict=True):
            self.cache[word] = (",".join(map(str, ids)), len(ids), self.decode(ids))

    def decode(self, ids: list[int]) -> str:
        """Text of a pre-token's ids (pre-tokens end between characters)."""
        return b"".join(map(self.octets.__getitem__, ids)).decode("utf-8", "replace")

    def parts(self, text: str) -> Iterator[tuple[list[str], int, list[str]]]:
        """Per piece: comma-joined ids per pre-token, number of ids, decoded pre-tokens."""
        for special, words in self.cutter.parts(text):
            if special:
                yield [str(self.cutter.special[special])], 1, [special]
            elif words:
                self.learn(words)
                ids, sizes, texts = zip(*map(self.cache.__getitem__, words), strict=True)
                yield ids, sum(sizes), texts

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the comma-joined ids, sha256 of the decoded text."""
        total, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        for ids, n, texts in self.parts(text):
            of_ids.update(((b"," if total else b"") + ",".join(ids).encode()))
            of_text.update("".join(texts).encode("utf-8"))
            total += n
        return total, of_ids.hexdigest(), of_text.hexdigest()

    def round_trip(self, text: str) -> tuple[list[int], str]:
        ids, decoded = [], []
        for part, _, texts in self.parts(text):
            ids += map(int, ",".join(part).split(","))
            decoded += texts
        return ids, "".join(decoded)


def _codec(docs: DataFrame, tokenizer_path: str, cache_size: int):
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    key = uuid.uuid4().hex
    return lambda: per_worker(key, lambda: Codec(shared.value, cache_size))


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  cache_size: int = 500_000) -> DataFrame:
    """``id``, ``ids`` (array of int) and ``decoded`` (their text) per input row.

    Ids equal the library's with add_special_tokens=False, truncation and padding
    unused.  Edge cases: a null text is empty and has no ids; repeated rows give
    repeated results; a null id stays null; an empty table gives no rows.
    """
    codec = _codec(docs, tokenizer_path, cache_size)

    @F.pandas_udf("ids array<int>, decoded string")
    def both(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([codec().round_trip(t or "") for t in texts], columns=["ids", "decoded"])

    return docs.select(F.col(id_col).alias("id"), both(F.col(text_col)).alias("out")).select("id", "out.*")


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   cache_size: int = 500_000) -> DataFrame:
    """``id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` per input row: the same round
    trip as ``encode_decode`` without moving the ids out of the workers."""
    codec = _codec(docs, tokenizer_path, cache_size)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([codec().digest(t or "") for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("id"), digests(F.col(text_col)).alias("out")).select("id", "out.*")
