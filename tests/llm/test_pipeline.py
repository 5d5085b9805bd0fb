"""The pipeline against the brute-force versions of its stages, and queries against their SQL."""

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from adlytics.llm import language, oracles, queries
from adlytics.llm.common import fold
from checks import compare
from corpus_cases import SCHEMA, awkward, clashing, documents, sentence
from corpus_cases import rows as rows_of_documents
from pyspark.sql import functions as F
from test_exact_dedup import brute as exact
from test_language import brute as predicted
from test_mixing import brute as mixed
from test_near_dedup import brute as near
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"
SCHEMA_NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute(spark, found):
    docs = spark.createDataFrame(found, SCHEMA)
    model = language.fit(docs, fold(F.col("doc_id"), 5) != 0)
    found = [r for r in found if predicted(model, r[1])[0] != "und" and predicted(model, r[1])[1] >= language.MIN_SCORE]
    kept = {(r[0], r[4]) for r in exact(found) if r[3]}
    sha = lambda t: hashlib.sha256(" ".join(chunk for chunk in split(t)).encode()).hexdigest()
    found = [r for r in dict.fromkeys(found) if (r[0], sha(r[1])) in kept]
    gone = {r[0] for r in near(found, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY) if not r[3]}
    found = [r for r in found if r[0] not in gone]
    copies = {r[0]: r[4] for r in mixed(found)}
    out = Counter()
    for i, text, lang, source, _ in found:
        ids = TOKENIZER.encode(text, add_special_tokens=False).ids
        decoded = hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        if copies[i]:
            out[i, lang, source, tuple(ids), len(ids), decoded] += copies[i]
    return out


def split(text):
    """Pieces between runs of ASCII white space, empty ones at the ends included."""
    import re

    return re.split(r"[\x20\x09-\x0D]+", text or "")


def result(rows):
    return Counter((r.doc_id, r.lang, r.source, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in rows.collect())


def test_run(spark):
    found = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert result(corpus_pipeline.run(spark, FOLDER)) == brute(spark, found)


def test_awkward_rows_through_every_stage(spark, tmp_path):
    found = [r for r in awkward() if r[0] is not None]
    documents(spark, found).write.parquet(str(tmp_path / "documents.parquet"))
    assert result(corpus_pipeline.run(spark, str(tmp_path))) == brute(spark, found)


def test_stages_keep_the_columns(spark):
    docs = documents(spark, awkward())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).dtypes == docs.dtypes


OWN = ("score", "lang_pred", "size", "source_size", "target", "copies", "taken", "_id", "_sha", "_copy", "_row", "rows", "id", "c0")


def test_stages_leave_other_columns_alone(spark):
    """Columns named like those of the operators keep their values through all stages but the last."""
    docs = clashing(documents(spark, awkward()), *OWN)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, FOLDER)
        assert rows.dtypes == docs.dtypes
        plain = stage(spark, docs.select(*SCHEMA_NAMES), FOLDER)
        assert compare._bag(SCHEMA_NAMES, [tuple(r) for r in rows.select(*SCHEMA_NAMES).collect()]) == compare._bag(
            SCHEMA_NAMES, [tuple(r) for r in plain.collect()]
        )
        assert {tuple(r) for r in rows.select(*OWN).distinct().collect()} == {tuple(f"extra {n}" for n in OWN)}


def test_near_copies_go_by_text(spark):
    """A text stays when only another text of its id is a near copy."""
    text, other = sentence(31, 80), sentence(32, 80)
    found = rows_of_documents((1, text), (2, text + " more"), (2, other), (3, other + " more"), (3, "short"), (None, text), (4, None), (4, ""))
    kept = corpus_pipeline.drop_near_copies(spark, documents(spark, found), FOLDER)
    ids = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert ids == sorted([(1, text), (2, other), (3, "short"), (None, text), (4, None), (4, "")], key=repr)


def test_empty_documents(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(oracles.all_sql()))
def test_query_against_sql(spark, name):
    found = queries.registered()[name](spark, FOLDER)
    answer = compare.connect(FOLDER).execute(oracles.all_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(found.columns)
    assert compare._bag(found.columns, [tuple(r) for r in found.collect()]) == compare._bag(names, answer.fetchall())


def test_exact_copies_of_whole_rows_against_sql(spark, tmp_path):
    import duckdb

    found = [r for r in awkward() if r[0] is not None]
    documents(spark, [*found, found[-1], found[-1]]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op3_exact_dedup(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    answer = con.execute(oracles.all_sql()["op3_exact_dedup"])
    names = [d[0] for d in answer.description]
    assert compare._bag(out.columns, [tuple(r) for r in out.collect()]) == compare._bag(names, answer.fetchall())
