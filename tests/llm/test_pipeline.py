"""The pipeline stage by stage against plain Python on its own input."""

import re

import corpus_pipeline


def test_stages_and_run(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs.collect(), spark.read.parquet(str(tmp_path / name)).collect())
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns

    before, after = seen["language_id"]
    letters = {r.doc_id for r in before if r.text and re.search(r"[^\W\d_]", r.text)}
    assert {r.doc_id for r in after} <= letters and len(after) >= 0.98 * len(letters)

    before, after = seen["exact_dedup"]
    best = {}
    for r in before:
        content = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[content] = min(best.get(content, (0, 1 << 62)), (-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(i for _, i in best.values())

    from tests.llm.test_dedup import brute_near

    before, after = seen["near_dedup"]
    _, label = brute_near([(r.doc_id, r.text) for r in before], 5)
    assert {r.doc_id for r in after} == {i for i, low in label.items() if i == low}

    from tests.llm.test_text import brute_taken

    before, after = seen["mixing"]
    taken = {i: t for i, _, _, _, t in brute_taken([(r.doc_id, r.text, None, r.source) for r in before])}
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got == {i: t for i, t in taken.items() if t}

    before, after = seen["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert sum(r.length for r in after) == sum(r.doc_tokens for r in after if r.start == 0)
