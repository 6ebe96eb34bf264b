"""The pipeline against plain versions of its stages."""

import brute
import corpus_pipeline as pipeline

from phasegrid.llm import queries as q


def test_each_stage_on_its_own_input(spark, folder, corpus):
    docs = q.table(spark, folder, "documents")
    read = lambda df: [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    for name, stage in pipeline.STAGES:
        before, after = read(docs), stage(spark, docs, folder)
        if name == "token_files":
            done = after.orderBy("start").collect()
            assert [r["doc_id"] for r in done] == sorted((d for d, _, _ in before), key=lambda d: (d is not None, d or 0))
            assert sum(r["n_tokens"] for r in done) == done[-1]["start"] + done[-1]["n_tokens"]
            break
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        left = read(after)
        if name == "quality":
            assert all(not brute.quality(t)[5] for _, t, _ in left)
            assert {d for d, t, _ in before if not brute.quality(t)[5] and len(t) < 5000} - {d for d, _, _ in left} <= {None, 66, 69, 75}
        elif name == "near_duplicates":
            roots = brute.components([brute.simhash(t) for _, t, _ in before])
            assert len(left) == len(set(roots)) == len(set(brute.components([brute.simhash(t) for _, t, _ in left])))
        elif name == "decontamination":
            dirty = brute.contamination([t for _, t, _ in before], corpus[1])
            assert sorted(str(d) for d, _, _ in left) == sorted(str(b[0]) for b, w in zip(before, dirty, strict=True) if not w[4])
            assert len(left) < len(before)
        elif name == "mixing":
            sizes = {}
            for _, t, s in before:
                sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
            for s, target in brute.targets(sizes).items():
                words = [len(brute.WORD.findall(t or "")) for _, t, of in left if of == s]
                assert abs(sum(words) - target) <= 1.5 * max(len(brute.WORD.findall(t or "")) for _, t, of in before if of == s) + 1
        docs = after


def test_run_and_empty_tables(spark, folder, empty_folder):
    assert pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert pipeline.run(spark, folder).count() > 20
    assert pipeline.run(spark, empty_folder).count() == 0
