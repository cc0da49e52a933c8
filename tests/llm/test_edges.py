"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import bpe, fingerprint, html, lm, media, neardup, packing, pii, quality, urls

LONG = "lorem ipsum dolor " * 8000 + "x" * 30_000
TEXTS = [None, "", " \n\t ", "one", "one two", "One TWO", "héllo wörld ñ", "a" * 5000, LONG, "mail bob@site.org now", "the same text here again and again", "the same text here again and again"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (3, "one"), (None, "no id at all"), (None, None), (4, "another text with the same id")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, digest string, label int, found string, bits string, bucket long, kind string, key long, n long, word string"


@pytest.fixture(scope="module")
def docs(spark):
    import tempfile

    rows = [(i, t, None, "s", None if t is None else len(t), 1.0, 7, "d", 1, "f", "b", 3, "k", 5, 2, "w") for i, t in ROWS]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/docs")
    return spark.read.parquet(f"{folder}/docs")


OPERATORS = {
    "neardup": lambda d: neardup.groups(d, 2, 80),
    "bpe": lambda d: bpe.encode_digests(d, tokenizer_path("word_bpe_49k.json")),
    "pii": pii.replaced,
    "fingerprint": fingerprint.compared,
    "quality": lambda d: quality.scored(d, quality.fit([quality.features("good text"), quality.features("BAD!! TEXT!!")] * 10, __import__("numpy").array([1, 0] * 10))),
    "lm": lambda d: lm.scores(d, F.col("doc_id") < 8, tokenizer_path("byte_bpe_50k.tiktoken")),
    "media": media.media_features,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_row_by_row(docs, name):
    """One row for each row, and equal rows for equal documents."""
    rows = OPERATORS[name](docs).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in ROWS)


@pytest.mark.parametrize("name", [*OPERATORS, "packing"])
def test_empty_table(docs, name):
    run = OPERATORS.get(name) or (lambda d: packing.pack_documents(d, tokenizer_path("byte_bpe_50k.json")))
    assert run(docs.limit(0)).count() == 0


def test_packing_edges(docs):
    rows = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total[0] == total[1] == 1 and total[3] == 3 * 2 and set(total) == {i for i, _ in ROWS}


def test_pages_edges(spark):
    schema = "page_id long, url string, html string, text string, host string, listed boolean"
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "<p>"), (4, "HTTP://A.Example.NET?x#y", "<article>" + "<p>word " * 9000), (4, "HTTP://A.Example.NET?x#y", "<<>>&#x;&amp"), (None, "a://b", "<article>x</article>")]
    pages = spark.createDataFrame([(*r, "t", "h", True) for r in rows], schema)
    got = urls.judged(pages).collect()
    assert len(got) == 6 and [(r.host, r.path, r.rule, r.verdict) for r in got if r.page_id in (1, 2, 3)] == [("", "", None, "allow")] * 3
    assert [r.host for r in got if r.page_id == 4] == ["a.example.net"] * 2
    out = html.extracted(pages).collect()
    assert len(out) == 6 and [r.n_chars for r in out if r.page_id in (1, 2, 3)] == [0, 0, 0] and {r.text for r in out if r.page_id is None} == {"x"} and max(r.n_chars for r in out) == 9000 * 5 - 1
    assert urls.judged(pages.limit(0)).count() == 0 and html.extracted(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, folder):
    """Each stage keeps the columns of documents, all but the last; a stage sees what the one before kept."""
    spark.createDataFrame([(3, 1, 0), (4, 1, 0), (7, 0, 0), (None, 0, 0), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (plain, plain.limit(0)):
            got = stage(spark, table, folder)
            assert got.columns == plain.columns and got.dtypes == plain.dtypes, name
            assert got.count() <= table.count()
    plain.write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0
    once = neardup.deduplicated(plain).select("doc_id", "text").collect()
    assert sum(r.text == "the same text here again and again" for r in once) == 1 and sum(r.doc_id == 3 for r in once) == 1


def test_hashes_agree(spark):
    """The digests and remainders of the contracts are those of Python's libraries."""
    row = spark.range(1).select(F.crc32(F.lit("123").cast("binary")).alias("a"), F.sha2(F.lit("é"), 256).alias("b")).first()
    assert row.a == zlib.crc32(b"123") and row.b == hashlib.sha256("é".encode()).hexdigest()
