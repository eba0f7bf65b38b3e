"""Spelling variants: group words one edit apart through a variable-length gram index.

Words are counted over the whole corpus.  Grams of two to ``longest`` characters are
counted over the distinct words; the gram dictionary holds every gram of two and the
longer ones whose beginning is frequent, so it follows the vocabulary's skew and is
bounded whatever the vocabulary.  A word (with a mark at both ends) is decomposed into
the longest dictionary gram at each place, without those that lie inside an earlier one.

One edit affects few grams of a word: those that hold its place, and those that the
dictionary lets grow over it.  For every possible edit the range of affected grams is
looked up; all others occur in the other word too.  So two near words share a last gram
before the edit and a first gram after it, with at most that many grams between, and
the lists of such gram pairs (each one a 61-bit hash of the text up to the first and
from the second gram on) hold every near pair.  Lists are merged by a join; the
short texts between the two grams are compared exactly.  Long lists are first cut by the
place of the edit, after which a list has at most one word per character.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, crc32_sql, materialise
from .pretokens import per_worker

RUNS = "A-Za-z\\u00C0-\\u00FF"
EDGES = "\x02", "\x03"           # marks of a word's beginning and end
PRIME = (1 << 61) - 1
BASE, BASE_BACK = 0x1D8AF4A3C5B7E921 % PRIME, 0x16B7D2C94F3A8E55 % PRIME
POSTING = "wid long, n long, key long, check int, low int, hole string"


def bands(shortest: int, longest: int) -> list[tuple[int, int | None, int]]:
    """(shortest word, longest word, longest gram): words of 3q - 4 characters or more always keep
    a gram of at most q untouched by any edit.  Neighbouring bands share their edge, so that words
    of neighbouring lengths meet in one of them."""
    out = []
    for q in range(2, longest + 1):
        high = None if q == longest else 3 * q - 1
        if high is None or high > shortest:
            out.append((max(3 * q - 4, 1), high, q))
    return out


class Grams:
    """The gram dictionary, with the proper beginnings and ends of its grams."""

    def __init__(self, grams: Iterable[str], longest: int):
        self.longest = longest
        self.known = frozenset(grams)
        self.heads = frozenset(g[:k] for g in self.known for k in range(2, len(g)))
        self.tails = frozenset(g[k:] for g in self.known for k in range(1, len(g) - 1))

    def decompose(self, s: str, q: int) -> tuple[list[int], list[int]]:
        """Starts and ends of the variable-length grams of ``s``; both increase."""
        starts, ends, reached, n, known = [], [], 0, len(s), self.known
        for p in range(n - 1):
            e = p + 2
            for k in range(min(q, n - p), 2, -1):
                if s[p:p + k] in known:
                    e = p + k
                    break
            if e > reached:
                starts.append(p)
                ends.append(e)
                reached = e
        return starts, ends

    def holes(self, s: str, q: int) -> tuple[set[tuple[int, int]], int]:
        """Texts between a last shared gram and a first shared gram after it that some edit allows,
        and the largest number of grams that one edit affects.

        An edit at ``i`` replaces or deletes a character (the rest begins at i + 1) or inserts
        one before it (the rest begins at i).  A gram before it is affected if it or an earlier one can
        grow over the place: the text from there to the edit begins a dictionary gram.  One after it is
        affected if a gram from the place on can swallow it: text up to its end ends a dictionary gram.
        """
        starts, ends = self.decompose(s, q)
        heads, tails, n, m = self.heads, self.tails, len(s), len(starts)
        out, most = set(), 0
        first = after = done = 0        # first affected gram, first one after the edit, grams that end before it
        for i in range(1, n):
            low = i - 1
            for k in range(min(q - 1, i), 1, -1):
                if s[i - k:i] in heads:
                    low = i - k
                    break
            while first < m and starts[first] < low:
                first += 1
            while first and starts[first - 1] >= low:
                first -= 1
            while done < m and ends[done] <= i:
                done += 1
            before = ends[first - 1:done] if first else [0, *ends[:done]]
            for right in (i, i + 1) if i < n - 1 else (i,):
                high = right + 1
                for k in range(min(q - 1, n - right), 1, -1):
                    if s[right:right + k] in tails:
                        high = right + k
                        break
                while after < m and starts[after] < right:
                    after += 1
                last = after
                while last < m and ends[last] <= high:
                    last += 1
                if last - first > most:
                    most = last - first
                for hi in starts[after:last + 1] if last < m else [*starts[after:], n]:
                    for lo in before:
                        out.add((lo, hi))
        return out, most


def rolling(s: str, seed: int) -> tuple[list[int], list[int]]:
    """Hashes of all beginnings and of all ends of ``s``."""
    front, back, h, g = [seed], [seed], seed, seed
    for c, d in zip(s, reversed(s), strict=True):
        h = (h * BASE + ord(c)) % PRIME
        front.append(h)
        g = (g * BASE_BACK + ord(d)) % PRIME
        back.append(g)
    return front, back[::-1]


def mixed(front: int, back: int) -> tuple[int, int]:
    """61 bits to meet by and 31 more to check."""
    x = front * 0x9E3779B97F4A7C15 + back * 0xC2B2AE3D27D4EB4F
    return (x ^ x >> 61) & PRIME, x >> 64 & 0x7FFFFFFF


def postings(word: str, grams: Grams, layout: list[tuple[int, int | None, int]]) -> list[tuple[int, int, int, str]]:
    """(key, check, place, hole): one per hole and band of the word; equal keys have equal texts around their holes."""
    s, out = EDGES[0] + word + EDGES[1], []
    for shortest, longest, q in layout:
        if shortest <= len(word) and (longest is None or len(word) <= longest):
            front, back = rolling(s, q)
            out += [(*mixed(front[lo], back[hi]), lo, s[lo:hi]) for lo, hi in grams.holes(s, q)[0]]
    return out


def split_postings(key: int, check: int, low: int, hole: str) -> list[tuple[int, int, int, str]]:
    """The same for one word of a long list, by the place of the edit: each character as a hole, and
    each gap between two as an empty one.  Words that meet here are one edit apart."""
    front, back = rolling(hole, check)
    holes = [(i, i + 1) for i in range(len(hole))] + [(i, i) for i in range(len(hole) + 1)]
    out = []
    for lo, hi in holes:
        out.append((*mixed(front[lo] * BASE + key, back[hi]), low + lo, hole[lo:hi]))
    return out


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: str = RUNS,
                min_chars: int = 5, min_count: int = 3, slip: int = 97) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased; where ``slip`` divides the CRC-32 of
    '<id>:<run>', the run loses one character first.  JVM only; counts combine map-side."""
    found = F.regexp_extract_all("text", F.lit(f"[{runs}]{{{min_chars},}}"), F.lit(0))  # greedy, so runs are whole
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), ascii_lower(F.col(text_col)).alias("text")).select(
        "id", F.explode(found).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % slip == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return (words.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where((F.col("n") >= min_count) & (F.length("word") >= min_chars)))


def gram_dictionary(words: DataFrame, longest: int, budget: int) -> list[str]:
    """Grams of three to ``longest`` characters whose beginning is frequent: it makes up more than
    one in ``budget`` of all grams of two.  At most ``budget`` beginnings a length are frequent,
    so the dictionary is bounded by their number and that of the letters."""
    marked = words.select(F.concat(F.lit(EDGES[0]), "word", F.lit(EDGES[1])).alias("s"))
    last = F.length("s")
    sizes = F.array([F.lit(k) for k in range(2, longest + 1)])
    grams = marked.select("s", F.explode(sizes).alias("k")).where(last >= F.col("k")).select(
        F.explode(F.transform(F.sequence(F.lit(1), last - F.col("k") + 1), lambda i: F.substr("s", i, F.col("k")))).alias("gram"))
    counts = materialise(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    total = counts.where(F.length("gram") == 2).agg(F.sum("n")).first()[0] or 0
    heads = [r.gram for r in counts.where((F.col("n") > total / budget) & (F.length("gram") < longest)).select("gram").collect()]
    spark = words.sparkSession
    frequent = spark.createDataFrame([(g,) for g in heads], "head string")
    held = counts.where(F.length("gram") > 2).withColumn("head", F.expr("substr(gram, 1, length(gram) - 1)"))
    return [r.gram for r in held.join(F.broadcast(frequent), "head", "left_semi").select("gram").collect()]


def ranked(words: DataFrame) -> DataFrame:
    """``wid`` numbers the words in code-point order (not densely)."""
    words = materialise(words, "words")  # the range exchange samples its input first
    return materialise(words.repartitionByRange("word").sortWithinPartitions("word").withColumn(
        "wid", F.monotonically_increasing_id()), "ranked-words")


def near_pairs(words: DataFrame, grams: list[str], longest: int, min_chars: int, long_list: int = 64) -> DataFrame:
    """(a, b, na, nb): ids and counts of all pairs of words one edit apart, a < b."""
    spark = words.sparkSession
    shared, key = spark.sparkContext.broadcast((grams, longest)), uuid.uuid4().hex
    layout = bands(min_chars, longest)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = per_worker(key, lambda: Grams(*shared.value))
        return posted_batches(batches, lambda row: postings(row["word"], index, layout))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return posted_batches(batches, lambda row: split_postings(row["key"], row["check"], row["low"], row["hole"]))

    posted = materialise(words.mapInArrow(post, POSTING), "postings")
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = materialise(posted.join(lists, "key"), "met-postings")  # most keys hold one word and go here
    long = materialise(met.where(F.col("size") > long_list).drop("size").mapInArrow(cut, POSTING), "cut-postings")
    return merge(met.where(F.col("size") <= long_list)).union(merge(long)).distinct()


def merge(posted: DataFrame) -> DataFrame:
    """(a, b, na, nb) of the words that meet in a list and whose holes are one edit apart."""
    x, y = posted.alias("x"), posted.alias("y")
    one_edit = (F.abs(F.length("x.hole") - F.length("y.hole")) <= 1) & (F.levenshtein(F.col("x.hole"), F.col("y.hole"), 1) == 1)
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "check", "low")]
    return x.join(y, [*same, F.col("x.wid") < F.col("y.wid"), one_edit]).select(
        F.col("x.wid").alias("a"), F.col("y.wid").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))


def posted_batches(batches: Iterator[pa.RecordBatch], make: Callable[[dict], list[tuple]], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Rows of POSTING, some thousands at a time, from the tuples that ``make`` gives for each row."""
    schema = pa.schema([("wid", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("check", pa.int32()), ("low", pa.int32()), ("hole", pa.string())])
    out: list[tuple] = []
    for batch in batches:
        for row in batch.to_pylist():
            out += [(row["wid"], row["n"], *p) for p in make(row)]
            if len(out) >= rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types, strict=True)], schema=schema)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types, strict=True)], schema=schema)


def follow(forms: DataFrame) -> DataFrame:
    """(wid, root) for (wid, form): the last word of every chain.  A form counts at least twice its
    word, so a chain is short; each round doubles the steps taken."""
    steps = materialise(forms.select("wid", F.col("form").alias("root")), "chains")
    while True:
        ahead = steps.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        joined = materialise(steps.join(ahead, "root", "left").select(
            "wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
        steps = joined.select("wid", "root")
        if not joined.where("moved").limit(1).count():
            return steps


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: str = RUNS, min_chars: int = 5,
                      min_count: int = 3, slip: int = 97, ratio: int = 2, longest: int = 4, budget: int = 1024) -> DataFrame:
    """One row per distinct word: ``word``, ``n``, ``form`` (its near word of largest n, the smaller word on
    a tie, if that n is at least ``ratio`` times the word's), ``root`` (from word, follow forms to the
    last), ``n_near`` and ``form_n``.

    Edge cases: null and empty texts hold no words; a null id counts as an empty one; rows that share
    an id are counted each; a very long text or word is treated like any other (keys grow with the
    word, not with its square); equal counts are never forms of each other while ``ratio`` is
    above one; extra columns of any name are ignored; an empty table gives no rows.
    """
    words = ranked(count_words(docs, id_col, text_col, runs, min_chars, min_count, slip))
    grams = gram_dictionary(words, longest, budget)
    pairs = near_pairs(words, grams, longest, min_chars)
    both = pairs.select(F.col("a").alias("wid"), F.col("b").alias("other"), F.col("nb").alias("n")).union(
        pairs.select(F.col("b"), F.col("a"), F.col("na")))
    best = materialise(both.groupBy("wid").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(
        (-F.col("n")).alias("less"), F.col("other"))).alias("best")), "nearest")
    judged = words.join(best, "wid", "left").select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                    F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.other")).alias("form"))
    judged = materialise(judged, "judged-words")
    roots = follow(judged.where("form is not null"))
    names = words.select(F.col("wid").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    ends = words.select(F.col("wid").alias("root"), F.col("word").alias("root_word"))
    return (judged.join(roots, "wid", "left").join(names, "form", "left").join(ends, "root", "left")
            .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"))


SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run
), h AS (
  SELECT *, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r
), w AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), d AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT a.word AS a, b.word AS b, b.n AS nb FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN w b ON a.cut = b.word
), f AS (
  SELECT w.word, w.n, count(b)::BIGINT AS n_near, CASE WHEN max(nb) >= 2 * w.n THEN first(b ORDER BY nb DESC, b) END AS form
  FROM w LEFT JOIN p ON p.a = w.word GROUP BY w.word, w.n
), c AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next
)
SELECT f.word, f.form, c.root, f.n, f.n_near, g.n AS form_n
FROM f JOIN c ON c.word = f.word AND c.next IS NULL LEFT JOIN w g ON g.word = f.form
"""
