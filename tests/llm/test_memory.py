"""What a Python worker is sent at once."""

import pytest
from albumen.llm import langid, ngram_join, storage, substring_dedup
from texts import corpus

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("run, module", [(ngram_join.keep_one, ngram_join), (langid.keep_identified, storage), (substring_dedup.remove_repeats, substring_dedup)])
def test_jobs_of_the_pipeline_send_few_texts_at_once(spark, documents, monkeypatch, run, module):
    held, was, plain = [], spark.conf.get(KEY), module.store

    def store(df, name):
        held.append((name, int(spark.conf.get(KEY))))
        return plain(df, name)

    monkeypatch.setattr(module, "store", store)
    docs = documents(corpus(3))
    docs = docs.selectExpr("*", "'en' AS lang") if "lang" not in docs.columns else docs
    assert run(docs).count() > 0
    sent = {name: n for name, n in held}
    job = {ngram_join: ("signatures", "posts"), storage: ("rejected",), substring_dedup: ("prints", "posted", "cut")}[module]
    assert all(sent[name] <= 1024 for name in job), sent
    assert spark.conf.get(KEY) == was
