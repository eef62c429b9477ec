import hashlib

import corpus_pipeline as P
import sentencepiece

from galleyproof.llm import pieces
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_neardup import brute as classes
from tests.llm.test_repeats import brute as repeated

SF = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    texts = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, texts[-1], SF).write.parquet(f"{tmp_path}/{k}")
        texts.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [[tuple(r) for r in t.select("doc_id", "text").collect()] for t in texts[:-1]]
    assert all(t.columns == names for t in texts[:-1])
    # near duplicates: one of each class
    assert sorted(i for i, _ in rows[2]) == sorted({c for _, c, _ in classes(rows[1])})
    # repeats: the kept bytes
    kept = {i: h for i, _, _, _, h in repeated(rows[2], 50)}
    cut = {i for i, _, n, _, _ in repeated(rows[2], 50) if n}
    assert all(hashlib.sha256(t.encode()).hexdigest() == kept[i] for i, t in rows[3] if i not in cut or not any(ord(c) > 127 for c in t))
    # benchmark: clean texts stay, hit ones lose words and keep no window
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0]: r[5] for r in contaminated(rows[3], items)}
    before = dict(rows[3])
    assert len(rows[4]) == len(rows[3]) and all((t == before[i]) != hit[i] for i, t in rows[4])
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    last = {r.doc_id: r for r in texts[-1].collect()}
    assert {i: (last[i].n_tokens, last[i].text_sha256) for i, _ in rows[4]} == {i: (len(library.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows[4]}


def test_run_gives_the_last_stage(spark):
    assert P.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_crc32", "n_chars", "text_sha256"]
