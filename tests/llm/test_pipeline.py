import corpus_pipeline
from loomkit.llm.common import table
from loomkit.llm.langid import identify
from loomkit.llm.quality import quality_rules
from pyspark.sql import functions as F
from tests.conftest import MEDIUM
from tests.llm.helpers import docs_frame
from tests.llm.test_minhash import brute


def test_stages_equal_brute_force(spark):
    docs = table(spark, MEDIUM, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, MEDIUM)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    known = {r.doc_id for r in identify(docs, declared=F.col("lang"), host=F.col("source")).where("kept").collect()}
    good = {r.doc_id for r in quality_rules(docs.where(F.col("doc_id").isin(list(known)))).where("kept").collect()}
    root = brute([(d, text[d]) for d in good], 5)
    assert kept == {d for d in good if root[d][1] == d}
    assert out.agg(F.sum("length")).first()[0] == out.dropDuplicates(["doc_id"]).agg(F.sum("doc_tokens")).first()[0]


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = docs_frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, MEDIUM)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, MEDIUM).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "packing"]
