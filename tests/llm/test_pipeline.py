"""The pipeline stage by stage on a small corpus, each against a plain version of its rule."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_neardup import classes
from tokenizers import Tokenizer

import corpus_pipeline

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    near = docs.limit(1).toPandas().iloc[0]
    odd = [(9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, "123 456 !!", "en", "src1", 10), (9004, near.text + " extra", near.lang, "src2", 0), (9005, near.text, near.lang, "src3", 0), (9006, "you idiot and moron of the", "en", "src1", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    out, docs = [spark.read.parquet(f"{corpus}/documents.parquet")], spark.read.parquet(f"{corpus}/documents.parquet")
    work = str(tmp_path_factory.mktemp("stages"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(f"{work}/{i}")
        docs = spark.read.parquet(f"{work}/{i}")
        out.append(docs)
    return [d.toPandas() for d in out]


def test_columns(stages):
    assert [len(corpus_pipeline.STAGES)] + [list(s.columns) for s in stages[1:5]] == [5] + [list(stages[0].columns)] * 4


def test_language_keeps_all_texts_with_letters(stages):
    want = {i for i, t in zip(stages[0].doc_id, stages[0].text) if t and any(c.isalpha() for c in t)}
    assert set(stages[1].doc_id) == want and len(stages[1]) == len(want)


def test_toxicity_keeps_clean_documents(spark, corpus, stages):
    """No document that a label calls clean goes; of those with one of the English insults nearly all go; few others do."""
    gone = set(stages[1].doc_id) - set(stages[2].doc_id)
    labels = spark.read.parquet(f"{corpus}/labels.parquet").toPandas()
    clean, bad = set(labels.doc_id[labels.toxic == 0]), set(labels.doc_id[labels.toxic == 1])
    insults = "idiot clown pathetic worthless stupid moron trash scum loser disgusting".split()
    has = {i for i, t in zip(stages[1].doc_id, stages[1].text) if any(w in t.lower() for w in insults)}
    # Labels of documents in other languages follow words of those languages, which the model learns too.
    assert not gone & clean and len(gone & has) >= 0.95 * len(has) and len(gone - has - bad) <= 0.005 * len(stages[1])


def test_one_of_each_near_duplicate_class(stages):
    rows = list(zip(stages[2].doc_id.tolist(), stages[2].text.tolist()))
    assert sorted(stages[3].doc_id) == sorted(set(classes(rows).values()))


def test_mixture_takes_source_shares(stages):
    words = lambda d: d.text.map(lambda t: len(t.split())).groupby(d.source).sum()
    before, after = words(stages[3]), words(stages[4])
    assert (after <= 3 * before[after.index]).all() and abs(after.sum() - before.sum()) < 0.02 * before.sum()
    per_doc = stages[4].groupby("doc_id").size()
    assert per_doc.max() <= 3 and set(stages[4].doc_id) <= set(stages[3].doc_id)


def test_packing_holds_every_token(stages):
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(len(ids.encode(t, add_special_tokens=False).ids) + 1 for t in stages[4].text)
    packed = stages[5]
    assert packed["length"].sum() == sum(want)
    full = packed.groupby("sequence_id")["length"].sum()
    assert full.max() <= 2048 and len(full) <= -(-packed["length"].sum() // 2048) + 2


def test_run_is_the_stages(spark, corpus, stages):
    got = corpus_pipeline.run(spark, corpus).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got[key].sort_values(key).values.tolist() == stages[5][key].sort_values(key).values.tolist()


def test_stages_of_awkward_tables(spark, corpus):
    """An empty table gives no rows, and extra columns named like the operators' own go along."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    extra = {c: F.lit("own") for c in ("_language", "_toxicity", "_id", "key0", "row_file", "node", "size", "words")}
    few = docs.where("doc_id < 40 or doc_id > 9000").withColumns(extra)
    for (_, stage), want in zip(corpus_pipeline.STAGES, (None, None, None, None, "pieces")):
        assert stage(spark, docs.where("false"), corpus).count() == 0
        got = stage(spark, few, corpus)
        rows = got.collect()
        assert rows and (want or (got.columns == few.columns and all(r[c] == "own" for r in rows for c in extra)))
