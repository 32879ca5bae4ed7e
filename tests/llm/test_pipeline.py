"""The pipeline stage by stage, each against plain code on its own input."""

import glob
import hashlib
import os
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public = pytest.importorskip("public_tokenizers")
from test_native_and_mix import plain_line_dedup  # noqa: E402
from test_shingles import plain_kept  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    seen = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, DATA).toPandas()) if len(seen) < 5 else stage(spark, docs, DATA)
        seen.append(docs.toPandas())
    start, clean, deduped, single, mixed, encoded = seen
    assert all(list(x.columns) == list(start.columns) for x in seen[1:5])
    gone = set(start.doc_id) - set(clean.doc_id)
    assert not [i for i in gone if labels.get(i) == 0] and clean.merge(start, on=list(start.columns)).shape == clean.shape
    assert dict(zip(deduped.doc_id, deduped.text, strict=True)) == plain_line_dedup(list(zip(clean.doc_id, clean.text, strict=True)))
    assert (deduped.n_chars == deduped.text.str.len()).all()
    assert set(single.doc_id) == plain_kept(list(zip(deduped.doc_id, deduped.text, strict=True))) and len(single) == single.doc_id.nunique()
    taken = Counter(mixed.doc_id)
    assert set(taken) <= set(single.doc_id) and max(taken.values()) <= 2
    theirs = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    text = dict(zip(mixed.doc_id, mixed.text, strict=True))
    assert Counter(encoded.doc_id) == taken
    for i, digest, decoded in zip(encoded.doc_id, encoded.ids_sha256, encoded.decoded_sha256, strict=True):
        ids = theirs.encode(text[i], add_special_tokens=False).ids
        assert digest == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and decoded == hashlib.sha256(text[i].encode()).hexdigest()


def test_run_and_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, DATA).count() > 50
    assert [sorted(os.listdir(d)) for d in glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/corpusflow/pipeline-*")] == [["4-bpe"]]
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, empty and long texts, and columns with names that stages use themselves."""
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "x y z", None, "t", 5), (None, None, None, None, None), (3, "", "en", "s", 0), (4, "word " * 300_000, "de", None, 9), (5, "a b c", "en", "u", 5)]
    extra = ("n_lines", "n_dropped", "copies", "taken", "size", "__c0", "__k0", "fp", "node", "ids", "like", "chunk", "p", "__gone", "__salt", "component_id", "line", "h")
    docs = spark.createDataFrame([(*r, *("x",) * len(extra)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in extra))
    spark.createDataFrame([(1, 0), (None, 1), (9, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == before.columns and docs.where("n_lines is null or n_lines <> 'x'").count() == 0
        if i < 2:
            assert docs.count() == len(rows)
    assert docs.count() > 0


def test_every_operator_is_registered():
    import re

    import __spark_entry__ as entry

    numbers = [int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert [int(x) for x in (3, 1, 7, 2, 10)] and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "bpe"]


@pytest.mark.parametrize("name", ["op1_line_dedup"])
def test_queries_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from corpusflow.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[names].itertuples(index=False))
    assert rows(ours) == rows(theirs)
