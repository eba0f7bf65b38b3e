"""The pipeline against a brute-force version of its filters."""

import re
import unicodedata

import corpus_pipeline
from credrisk.llm import language_id, simhash


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        assert docs.columns == columns
        seen[name] = (before, {r.doc_id: r for r in docs.collect()})
    before, after = seen["language_id"]
    assert all((i in after) == bool(r.text and any(unicodedata.category(c)[0] == "L" for c in r.text)) for i, r in before.items())
    before, after = seen["line_dedup"]
    assert set(after) == set(before) and any(after[i].text != before[i].text for i in after)
    assert all(r.n_chars == len(r.text) for r in after.values())
    before, after = seen["simhash"]
    fps = {i: simhash.simhash64(r.text) for i, r in before.items()}
    root = dict.fromkeys(fps)
    for i in sorted(fps):
        if root[i] is None:
            todo = [i]
            while todo:
                x = todo.pop()
                if root[x] is None:
                    root[x] = i
                    todo += [y for y in fps if root[y] is None and ((fps[x] ^ fps[y]) % 2**64).bit_count() <= 2]
    assert set(after) == {i for i in fps if root[i] == i}
    before, after = seen["decontamination"]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    bench = {tuple(w[k:k + 10]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in [cut(r.text)] for k in range(len(w) - 9)}
    assert set(after) == {i for i, r in before.items() if not any(tuple(cut(r.text)[k:k + 10]) in bench for k in range(len(cut(r.text)) - 9))}
    assert len(after) < len(before)
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.collect()} == set(after)


def test_stages_take_empty_and_odd_tables(spark):
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, row long"
    long = "a long text of many words " * 20_000
    odd = spark.createDataFrame([(1, None, None, None, None, "a", 1), (1, "", "en", "s", 0, "b", 2), (None, "some words here", "en", "s", 15, "c", 3),
                                 (4, long, "en", "s", len(long), "d", 4), (5, long + "end", "en", "s", len(long) + 3, "e", 5)], schema)
    for frame in (spark.createDataFrame([], schema), odd):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs.collect()
    assert language_id.UNDETERMINED == "und"
