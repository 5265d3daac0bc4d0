import random

import corpus_pipeline
from voxloom.llm import queries


def prose(r: random.Random, n: int) -> str:
    """Words among which no three repeat often, with the function words of English."""
    plain = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split()
    return " ".join(r.choice(plain) if r.random() < 0.4 else "".join(r.choices("abcdefghilmnoprstu", k=r.randint(3, 8))) for _ in range(n))


def test_stages_and_registry(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))


def tables(spark, path, rows, bench):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def test_run_keeps_one_of_each_group(spark, tmp_path):
    r = random.Random(3)
    base, other, bench = prose(r, 300), prose(r, 300), prose(r, 120)
    words = base.split()
    near = " ".join([*words[:3], "quite", *words[3:]])
    # cut into lines elsewhere than the first, so that line dedup leaves it to the near-duplicate stage
    lines_a = "\n".join(" ".join(words[k : k + 50]) for k in range(0, 300, 50))
    lines_b = "\n".join([" ".join(near.split()[:25]), *(" ".join(near.split()[k : k + 50]) for k in range(25, 301, 50))])
    rows = [(1, lines_a), (2, lines_b), (3, other), (4, "short"), (5, bench), (6, None), (7, ""), (8, lines_a), (8, lines_a), (None, None)]
    tables(spark, tmp_path, rows, [(1, bench), (2, None)])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out if r.doc_id is not None} == {1, 3}
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
