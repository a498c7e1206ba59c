import collections

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm.common import tokenizer_file


def test_stages_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(900001, None, "en", "src0", 0), (900002, "12 34 !!", "en", "src0", 8), (900003, "password=abcdef123456 the end", "en", "src0", 29)], docs.schema)
    docs = docs.unionByName(extra)
    for clash in ("lang_pred", "score", "redacted", "spans", "n_hex", "n_novel", "_source", "_copies", "_copy", "target", "other_column_0", "node", "a.b"):
        docs = docs.withColumn(clash, F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "secret_scan", "mixing", "sentencepiece"]
    kept, seen = docs, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.cut(stage(spark, kept, sf), "test")
        seen.append(kept)
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    one, two, three, four, last = (df.collect() for df in seen[1:])
    assert {r.doc_id for r in one} == {r.doc_id for r in docs.collect()} - {900001, 900002}
    assert {r.doc_id for r in two} < {r.doc_id for r in one} and len({r.doc_id for r in two}) == len(two)
    assert {r.doc_id for r in three} == {r.doc_id for r in two}
    assert next(r.text for r in three if r.doc_id == 900003) == "[SECRET] the end"
    taken = collections.Counter(r.doc_id for r in four)
    assert set(taken) <= {r.doc_id for r in three} and max(taken.values()) <= 2 and 2 in taken.values()
    assert collections.Counter(r.doc_id for r in last) == taken
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in four}
    assert all(list(r.ids) == library.encode(text[r.doc_id]) for r in last)
