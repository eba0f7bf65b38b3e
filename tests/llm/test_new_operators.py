"""Spelling variants, Merkle manifest and URL filter against brute-force versions and their SQL twins."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from credrisk.llm import merkle, queries, spelling, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, word string, n long, block int, hash string, other string, key int"


def plain(frame, columns):
    """Rows as tuples with None for every kind of missing value."""
    values = [[None if pd.isna(x) else x for x in frame[c].tolist()] for c in columns]
    return sorted(zip(*values), key=repr) if len(frame) else []


def documents(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "w", 1, 2, "h", "o", 3) for i, t, s in rows], SCHEMA)


def run(spark, tmp_path, name, frame, which):
    frame.write.mode("overwrite").parquet(f"{tmp_path}/{which}.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {which} AS SELECT * FROM read_parquet('{tmp_path}/{which}.parquet/*.parquet')")
    want = con.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert [tuple(float(x) if isinstance(x, int) else x for x in r) for r in plain(got, columns)] == [
        tuple(float(x) if isinstance(x, int) else x for x in r) for r in plain(want, columns)]
    return got


# --- spelling variants --------------------------------------------------------------------------
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def spelled(rows, slip=97):
    n = Counter()
    for i, t, *_ in rows:
        for run_ in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run_ = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run_)
            h = zlib.crc32(f"{'' if i is None else i}:{run_}".encode())
            n[run_ if h % slip else run_[:h % len(run_)] + run_[h % len(run_) + 1:]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    root = {}
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        root[w] = r
    return {(w, form[w], root[w], n[w], count[w], n.get(form[w])) for w in n}


def corpus():
    rng = random.Random(11)
    stems = ["color", "theatre", "straße", "élève", "banana", "abcdefghijklmnopqrstuvwxyz", "aaaaaa", "ababababab", "z" * 3000]
    pool = []
    for s in stems:
        pool += [s] * 24
        for _ in range(12):
            v = s
            for _ in range(rng.choice([1, 1, 2])):
                k, c = rng.randrange(len(v) + 1), rng.choice("abéÿz")
                v = rng.choice([v[:k] + c + v[k:], v[:k] + c + v[k + 1:], v[:k] + v[k + 1:]])
            pool += [v] * rng.choice([3, 3, 6, 7, 13])
    pool += [f"common{a}{b}" for a in "abcdefghijkl" for b in "abcdefghij"] * 3   # a list of over 64 words
    rng.shuffle(pool)
    rows = [(k, " ".join(rng.choice([w, w.upper() if w.isascii() else w]) + rng.choice([" ", "1", "-", "××", "\n"]) for w in pool[k::9]), "s") for k in range(9)]
    return rows + [(50, None, "s"), (51, "", None), (52, " 12 ... ", "s"), (None, "color color color", "s"), (53, "color colour", "s"), (53, "color colour", "s"),
                   (54, "word " * 40_000, "s"), (55, "lonely " * 3, "s")]


def test_spelling_variants_equal_brute_force(spark, tmp_path):
    rows = corpus()
    got = run(spark, tmp_path, "op11_spelling_variants", documents(spark, rows), "documents")
    want = spelled(rows)
    assert set(plain(got, ["word", "form", "root", "n", "n_near", "form_n"])) == want and len(want) > 100 and any(f and f != r for _, f, r, *_ in want)


def test_spelling_variants_of_an_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, "op11_spelling_variants", documents(spark, []), "documents").empty
    assert run(spark, tmp_path, "op11_spelling_variants", documents(spark, [(1, None, None), (2, "a b", "s")]), "documents").empty


@pytest.mark.parametrize("letters, low, high, longest, budget", [("ab", 5, 9, 4, 8), ("abc", 5, 12, 4, 20), ("ab", 2, 7, 4, 1000), ("ab", 5, 16, 5, 30)])
def test_gram_lists_hold_every_near_pair(letters, low, high, longest, budget):
    rng = random.Random(budget)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(500)}
    words |= {w[:k] + rng.choice(letters) + w[k:] for w in list(words) for k in [rng.randrange(len(w))]}
    counts = Counter(s[i:i + k] for w in words for s in ["\x02" + w + "\x03"] for k in range(2, longest + 1) for i in range(len(s) - k + 1))
    total = sum(n for g, n in counts.items() if len(g) == 2)
    index = spelling.Grams([g for g in counts if len(g) > 2 and counts[g[:-1]] > total / budget], longest)
    lists, layout = {}, spelling.bands(low, longest)
    for w in words:
        for key, check, at, hole in spelling.postings(w, index, layout):
            lists.setdefault((key, check, at), []).append((w, hole))
            for part in spelling.split_postings(key, check, at, hole):
                lists.setdefault(("cut", *part[:3]), []).append((w, part[3]))
    found, cut = ({frozenset((a, b)) for k, held in lists.items() if (k[0] == "cut") == c for (a, x), (b, y) in itertools.combinations(held, 2) if near(x, y)}
                  for c in (False, True))
    want = {frozenset(p) for p in itertools.combinations(words, 2) if near(*p)}
    assert found == want and cut == want
    for w in words:
        for shortest, most, q in layout:
            if shortest <= len(w) and (most is None or len(w) <= most):
                assert index.holes("\x02" + w + "\x03", q)[1] < len(index.decompose("\x02" + w + "\x03", q)[0])  # a gram always stays


# --- Merkle manifest --------------------------------------------------------------------------------
def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(leaves):
    """Root and, per leaf, the (left, right) digests of every level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[k:k + 16] for k in range(0, len(level), 16)]
        for leaf, p in enumerate(at):
            r = runs[p // 16]
            paths[leaf].append(("".join(r[:p % 16]), "".join(r[p % 16 + 1:])))
            at[leaf] = p // 16
        level = [sha("".join(r)) for r in runs]
    return (level or [None])[0], paths


def manifest(rows):
    def leaf(i, t, s):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, "en", None if t is None else len(t), t)))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in groups}
    trees = {s: tree([leaf(*r) for r in order[s]]) for s in groups}
    root, above = tree([trees[s][0] for s in groups])
    out = []
    for s, up in zip(groups, above):
        for r, path in zip(order[s], trees[s][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            fold = leaf(r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), r[2]) if hit else leaf(*r)
            for left, right in path + up:
                fold = sha(left + fold + right)
            out.append((r[0], leaf(*r), trees[s][0], root, sha("".join(a + b for a, b in path + up)), fold, fold == root))
    return sorted(out, key=repr)


def check_manifest(spark, tmp_path, rows):
    got = run(spark, tmp_path, "op12_merkle_manifest", documents(spark, rows), "documents")
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(((None if r[0] is None else int(r[0]), *r[1:]) for r in plain(got, cols)), key=repr) == manifest(rows)
    return got


def test_merkle_manifest_over_several_blocks(spark, tmp_path):
    rows = [(k * 7 % 9001, f"Text {k}", "hot") for k in range(4500)] + [(k, f"T{k}", f"s{k % 40}") for k in range(300)]
    rows += [(9100, "ONE", "alone"), (9101, None, None), (9102, "", None), (None, "no Id", "hot"), (5, "Twice", "hot"), (5, "Twice", "hot"),
             (9103, "L" * 200_000, "ß"), (9104, "ünï A", ""), (9105, "plain", "z")]
    rows += [(10_000 + k, "X", "sixteen") for k in range(16)] + [(11_000 + k, "X", "seventeen") for k in range(17)] + [(12_000 + k, "X", "block") for k in range(4096)]
    got = check_manifest(spark, tmp_path, rows)
    assert 0 < (~got.verified).sum() < len(rows) / 4


def test_merkle_manifest_of_few_rows(spark, tmp_path):
    check_manifest(spark, tmp_path, [])
    check_manifest(spark, tmp_path, [(1, "A", "s")])
    check_manifest(spark, tmp_path, [(1, "A", None), (2, None, None), (3, "B", "s")])


def test_merkle_places_continue_over_partitions(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit("a")).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("group"), "id", F.lit("h").alias("hash"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = merkle.numbered(rows, ["group"], ["id"], "test").toPandas().sort_values(["group", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert (placed.place == placed.groupby("group").cumcount()).all() and len(placed) == 5000


# --- URL filter ---------------------------------------------------------------------------------------
def pages(spark, urls):
    return spark.createDataFrame([(k, u, "<p>", "h", "t", 5) for k, u in enumerate(urls)], "page_id long, url string, html string, host string, template string, n int")


URLS = [None, "", "no scheme", "http://", "http://x.com", "http://x.com?", "http://x.com/", "HTTP://WWW.X.COM/a?b://c/d", "http://ÀB.com/É", "mailto:x://y.net/es/1#z",
        "http://example.com/en/1", "http://a.example.com/en/1", "http://www.example.com/en/1", "http://b.www.example.com/en/2", "http://notexample.com/en/1",
        "http://example.com/EN/1", "http://net/es/", "http://netes.net/es", "http://q.net/fr/x", "http://q.net/frx", "http://com/", "http://r.com//en/", "http://p.org/a b/{c}|*/d",
        "http://deep.org/" + "/".join("abcdefghijkl"), "http://long.org/" + "x" * 100_000, "http://many.org/" + "s/" * 20_000, "ftp://u:p@h.net:80/fr/1"]


def test_url_filter_rules_and_twin(spark, tmp_path):
    got = run(spark, tmp_path, "op13_url_filter", pages(spark, URLS * 2), "pages").sort_values("page_id")

    def judged(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, None))
    for row, url in zip(got.itertuples(), URLS * 2):
        host, path, rule, verdict = judged(url)
        assert (row.host, row.path, row.rule) == (host, path, rule), url
        assert row.verdict in ("allow", "block") and (verdict is None or row.verdict == verdict)


def test_url_templates(spark, tmp_path):
    rng = random.Random(4)
    urls = [f"http://shop.net/{lang}/item-{rng.randrange(10**6)}/{rng.choice('pqrst')}{k}" for k in range(300) for lang in ("es", "fr", "en", "de")]
    urls += [f"http://shop.net/rare{chr(97 + k % 26)}{chr(97 + k // 26)}/x" for k in range(60)]
    urls += ["http://few.net/es/1", "http://few.net/fr/2", "http://few.net/es/3", "http://few.net/en/4"]    # all in one wildcard of blocked urls
    urls += [f"http://m{k}.example.com/en/{k}" for k in range(3)] + [None]
    got = run(spark, tmp_path, "op13_url_filter", pages(spark, urls), "pages").sort_values("page_id")
    of = dict(zip(urls, got.itertuples()))
    assert {r.template for u, r in of.items() if u and "shop.net/e" in u or u and "shop.net/f" in u or u and "shop.net/d" in u} == {
        "shop.net/es|fr/item-{n}/p{n}|q{n}|r{n}|s{n}|t{n}", "shop.net/de|en/item-{n}/p{n}|q{n}|r{n}|s{n}|t{n}"}
    assert {r.template for u, r in of.items() if u and "rare" in u} == {"shop.net/*/x"}
    assert of["http://few.net/en/4"].verdict == "block" and of["http://few.net/en/4"].rule is None
    assert of["http://shop.net/rareaa/x"].verdict == "allow"


def test_url_filter_of_an_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, "op13_url_filter", pages(spark, []), "pages").empty


def test_url_filter_is_native(spark):
    plan = url_filter.judge_urls(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
