"""The pipeline against a plain version of its stages on one small table."""
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from sheetmetric.llm import packing, quality, toxicity
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_secrets import brute as spans

SF = "/root/testdata/sf0.001"


def plain(spark):
    """(doc_id, text) that packing should get."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    learnt = sorted((i, t) for i, t in rows if i in toxic)
    model = toxicity.train([t for _, t in learnt], [toxic[i] for i, _ in learnt])
    scores = toxicity.Scorer(model).score([t for _, t in rows])
    rows = [r for r, s in zip(rows, scores) if s < toxicity.THRESHOLD and quality.kept(r[1], quality.RULES)]
    first = {i for i, _, c in groups(rows) if i == c}
    out = []
    for i, t in rows:
        if i in first:
            new, at = "", 0
            for a, _, b in spans(t):
                if a > at or not new:
                    new += t[at:a] + "[SECRET]"
                at = max(at, b)
            out.append((i, new + t[at:]))
    return out


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    want = plain(spark)
    rows = corpus_pipeline.run(spark, SF).collect()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in want}
    pieces = sorted((i, k, s, n, zlib.crc32(np.array(own[s:s + n], "<u4").tobytes())) for i, own in ids.items() for k, (s, n) in enumerate(packing.cuts(len(own))))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    assert 0 < len(want) < 200


def test_stages_keep_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS score", "2 AS sig", "'x' AS spans")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0
