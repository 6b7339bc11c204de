"""The pipeline's stages and its run() against plain versions, stage by stage, on a whole small table."""

import re
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quiremill.llm import bpe, quality  # noqa: E402
from quiremill.llm.queries import vocabulary  # noqa: E402

EXTRA = [
    (90_000, "Clean words that say something new about nothing in particular, token = abcdef123456 and on it goes until the end of it.", "en"),
    (90_001, None, "en"),
    (90_002, "", "en"),
    (90_003, "Clean words that say something new about nothing in particular, token = abcdef123456 and on it goes until the end of it.", "fr"),
]


@pytest.fixture(scope="module")
def table(spark, sf, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipe"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(i, t, g, "src0", len(t or "")) for i, t, g in EXTRA], docs.schema)
    docs.unionByName(extra).withColumn("score", F.lit("x")).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def rows(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, table, tmp_path_factory):
    at, docs, out = str(tmp_path_factory.mktemp("stages")), spark.read.parquet(f"{table}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, table).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        out.append(docs)
    return spark.read.parquet(f"{table}/documents.parquet"), *out


def test_columns_stay(stages):
    for d in stages[:-1]:
        assert d.columns == stages[0].columns


def test_quality(spark, table, stages):
    labels = spark.read.parquet(f"{table}/labels.parquet")
    good = {r.doc_id for r in quality.classify(stages[0], labels).where("predicted = 1").collect()}
    assert set(rows(stages[1])) == good


def test_neardup(stages):
    before = rows(stages[1])
    want = brute.neardup([(i, r.text) for i, r in before.items()], k=5, num=80, den=100)
    assert set(rows(stages[2])) == {i for i, (_, c) in want.items() if i == c}


def test_substring(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = brute.substring([(i, r.text) for i, r in before.items()])
    assert set(before) == set(after)
    for i, r in after.items():
        words, gone, sha = want[i]
        if gone:
            import hashlib

            assert hashlib.sha256(r.text.encode()).hexdigest() == sha and r.n_chars == len(r.text)
        else:
            assert r.text == before[i].text


def test_secrets(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for i, r in after.items():
        text = before[i].text
        n = brute.secrets(text)
        if not sum(n[:3]):
            assert r.text == text or re.search(r"\[(pem|forge|jwt)\]", r.text)
        else:
            assert not sum(brute.secrets(r.text)[:3]) and re.search(r"\[(assign|access|hex)\]", r.text)


def packed(docs, pieces):
    t, by = bpe.tokenizer(vocabulary("word_bpe_49k.json")), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    assert set(by) == set(docs)
    for i, r in docs.items():
        ids, at = [*t.encode(r.text or "", add_special_tokens=False).ids, 2], 0
        for p in sorted(by[i], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)


def test_packing(stages):
    packed(rows(stages[4]), stages[5].collect())


def test_run(spark, table, stages):
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    got = corpus_pipeline.run(spark, table).select(*key).collect()
    packed(rows(stages[4]), corpus_pipeline.run(spark, table).collect())
    assert {r.doc_id for r in got} == set(rows(stages[4]))


def test_empty(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    assert corpus_pipeline.run(spark, at).collect() == []
