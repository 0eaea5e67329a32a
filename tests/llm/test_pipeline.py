"""The pipeline's stages, each on what its predecessor kept."""


import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import quality
from millrace.llm.common import materialize, read


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = read(spark, small, "documents")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, materialize(stage(spark, out[-1][1], small))))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(stages, spark, small):
    assert [n for n, _ in stages[1:]] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "packing"]
    for _, df in stages[1:-1]:
        assert df.columns == stages[0][1].columns and df.dtypes == stages[0][1].dtypes
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).drop("sequence_id").collect())) == sorted(map(tuple, stages[-1][1].drop("sequence_id").collect()))


def test_quality_stage(stages, spark, small):
    docs = stages[0][1]
    scored = quality.score(docs, quality.fit(docs, read(spark, small, "labels")))
    assert texts(stages[1][1]) == texts(scored.where("predicted = 1"))
    labels = {r.doc_id: r.quality for r in read(spark, small, "labels").collect()}
    kept = texts(stages[1][1])
    good = [i for i in texts(docs) if labels.get(i) == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


def test_line_stage(stages):
    before = list(texts(stages[1][1]).items())
    assert texts(stages[2][1]) == dict(zip((i for i, _ in before), brute.line_dedup(before)))


def test_jaccard_stage(stages):
    before = list(texts(stages[2][1]).items())
    leads = {i for i, (_, c) in brute.jaccard(before).items() if i == c}
    assert set(texts(stages[3][1])) == leads


def test_mixing_stage(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in (stages[3][1], stages[4][1]))
    size = lambda t: len((t or "").split())
    assert all(size(after[i].text) <= 3 * size(before[i].text) and set(after[i].text.split()) <= set(before[i].text.split()) for i in after)
    assert all(r.n_chars == len(r.text) for r in after.values())
    total = sum(size(r.text) for r in before.values())
    assert abs(sum(size(r.text) for r in after.values()) - total) < 0.05 * total


def test_packing_stage(stages):
    from test_text_ops import check_pieces

    import numpy as np

    from millrace.llm import packing

    enc, _ = packing.coder()
    ids = {i: np.array([*enc.encode_ordinary(t), 1], "<u4") for i, t in texts(stages[4][1]).items()}
    check_pieces(stages[5][1].collect(), ids, 0.02)


def test_edges(spark, small):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y z"), (None, "u v w"), (4, "hot " * 3000)]
    docs = spark.createDataFrame([(i, t, None, None, None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, gone int")
    stages = dict(corpus_pipeline.STAGES)
    for stage in stages.values():
        assert stage(spark, docs.where(F.lit(False)), small).count() == 0
    out = {name: stage(spark, docs, small).collect() for name, stage in stages.items()}
    pairs = lambda rows: sorted((r.doc_id or 0, r.text or "") for r in rows)
    known = sorted((i or 0, t or "") for i, t in rows)
    # equal rows are judged alike
    judged = pairs(out["quality classifier"])
    assert set(judged) <= set(known) and judged.count((3, "a b c")) in (0, 2)
    assert pairs(out["line dedup"]) == known
    assert pairs(out["n-gram Jaccard join"]) == sorted(set(known))
    # all words of the mix: one source, so each is taken once
    assert sum(len(t.split()) for _, t in pairs(out["mixing sources"])) == sum(len(t.split()) for _, t in known)
    assert len([r for r in out["mixing sources"] if r.doc_id is None]) == 2 and all(r.gone == 1 for r in out["mixing sources"])
    pieces = out["packing"]
    assert {r.doc_id for r in pieces} == {None, 1, 2, 3, 4} and sum(r.length for r in pieces if r.doc_id in (1, 2)) == 2
    same = corpus_pipeline.one_of_each_group(spark, docs, small)
    assert same.where("doc_id = 3").count() == 1 and same.where("doc_id IS NULL").count() == 2


def test_group_stage_keeps_other_texts_of_an_id(spark, small):
    """A text goes only with a group of its own copies, not because its row shares an id with one."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a, 7), (2, a + " more", 8), (2, b, 9), (2, b, 9), (3, b, 9), (4, "alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    kept = corpus_pipeline.one_of_each_group(spark, docs, small)
    assert kept.columns == ["doc_id", "text", "id"]
    got = [(r.doc_id, r.text, r.id) for r in kept.collect()]
    assert sorted(t for _, t, _ in got if t == "alone" or t == b) == ["alone", b] and len([t for _, t, _ in got if t.startswith(a)]) == 1 and len(got) == 3
