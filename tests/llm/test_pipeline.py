"""The pipeline on a small table: what each stage must drop, change and keep."""

import random

from terraline.llm import queries


def test_run(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80))
    clean = [text() for _ in range(30)]
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[3], "en", "src1", 0), (101, "too short", "en", "src1", 0), (102, "the cat sat " * 60, "en", "src1", 0), (103, text() + ' token = "0123456789abcdef0123456789abcdef" ', "en", "src1", 0), (104, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        out[r.doc_id] = r
    assert set(out) == {*range(30), 103}
    assert all(r.round_trip for r in out.values())
    t = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    assert all(out[i].ids == t.encode(clean[i], add_special_tokens=False).ids for i in range(30))
    assert "[SECRET]" in t.decode(out[103].ids) and "0123456789abcdef" not in t.decode(out[103].ids)
