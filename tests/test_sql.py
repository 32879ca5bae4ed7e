"""Functions by name in SQL against their column forms."""

from pyspark.sql import functions as F

from corpusflow.functions import shapes, sql, vectors
from corpusflow.operators.tokenizer import Tokenizer


def test_functions(spark):
    tokenizer = Tokenizer({"pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "WordPiece", "unk_token": "u", "vocab": {"u": 0, "a": 1, "##b": 2}}})
    sql.register(spark, words=tokenizer)
    rows = spark.range(1, 3000).selectExpr("two_bit_bucket_len(id) a", "id").select("a", shapes.two_bit_len(F.col("id")).alias("b"))
    assert rows.where("a <> b").count() == 0
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    for name in ("dot", "cosine", "euclidean", "manhattan"):
        both = df.select(F.expr(f"{name}_similarity(a, b)").alias("x"), vectors.similarity(name, F.col("a"), F.col("b")).alias("y"))
        assert both.where("abs(x - y) > 1e-12 or x is null").count() == 0
    assert spark.sql("SELECT l2_normalize(array(3D, 4D)) v, pad_row(array(1, 2, 3), 2, 9) p, pad_row(array(1), 3, 9) q").first().asDict() == {"v": [0.6, 0.8], "p": [1, 2], "q": [1, 9, 9]}
    row = spark.sql("SELECT words_encode('a ab c') e, words_decode(words_encode('ab a')) d").first()
    assert row["e"] == [1, 1, 2, 0] and row["d"] == "ab a"
