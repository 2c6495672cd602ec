"""What moves: words of a text, rows of frequent keys, tables that lie in buckets by item."""

from pyspark.sql import functions as F

from labelmesh.models.corpus import Corpus, laid_by_item, lay_out
from labelmesh.operators import joins, prep
from labelmesh.skew import Spread


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_are_counted_where_their_text_is(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (None, "a"), (2, None), (3, "  ")], "item_id long, text string")
    bag = prep.bag_of_words(docs)
    assert exchanges(bag) == 1
    assert sorted(map(tuple, bag.collect()), key=repr) == sorted([(1, "a", 2.0), (1, "b", 2.0), (1, "c", 1.0), (None, "a", 1.0)], key=repr)


def test_laid_features_are_read_as_they_lie(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} all".replace("0", "x").replace("1", "y").replace("2", "z")) for i in range(20)], "item_id long, text string")
    laid = lay_out(prep.bag_of_words(docs), prep.item_parts(docs), ["item_id"])
    assert laid_by_item(laid.table) and not laid_by_item(docs)
    ann = docs.select("item_id", F.lit(0).alias("annotator_id"), F.lit(1).alias("label"), F.lit(1).cast("bigint").alias("n"))
    corpus = Corpus.build(ann, docs, 2, laid.table)
    assert len(corpus.layouts) == 1
    p = docs.select("item_id", F.array(F.lit(0.25), F.lit(0.75)).alias("p"))
    seen = {r["feature"]: list(r["c"]) for r in corpus.soft_vocab(p).collect()}
    assert seen["all"] == [5.0, 15.0]
    corpus.release()
    assert laid.table.count() == 40
    laid.drop()
    assert not laid_by_item(docs)


def test_only_rows_of_rare_keys_are_shuffled(spark, monkeypatch):
    big = spark.createDataFrame([("a", i) for i in range(9)] + [("b", i) for i in range(5)] + [("c", 0), ("d", 1), (None, 2), ("e", 3)], "k string, i int")
    table = spark.createDataFrame([(k, float(ord(k))) for k in "abcdf"], "k string, v double")
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 80)
    monkeypatch.setattr(joins, "fits_broadcast", lambda rows, row_bytes: False)
    spread = Spread.with_counts(big, ["k"], ["i"])
    assert sorted(r["k"] for r in spread.frequent(2).collect()) == ["a", "b"]
    assert spread.frequent(0) is None
    found = joins.attach(big, table, ["k"], ["i"], 1, 5, spread)
    want = big.join(table, "k")
    assert sorted(map(tuple, found.select("k", "i", "v").collect())) == sorted(map(tuple, want.select("k", "i", "v").collect()))
    assert "LeftAnti" in plan(found)


def test_tokens_stay_with_their_document(spark):
    from labelmesh.models.topics import TopicLabelModel

    docs = spark.createDataFrame([(i, "apple pear plum " * (i % 4 + 1)) for i in range(12)], "item_id long, text string")
    ann = docs.select("item_id", F.lit(0).alias("annotator_id"), F.pmod("item_id", F.lit(2)).cast("int").alias("label"), F.lit(1).cast("bigint").alias("n"))
    tokens, found = prep.tokenize(docs), []
    for dealt in (0, prep.item_parts(docs)):
        model = TopicLabelModel.start(tokens, ann, docs, 2, 3, seed=2, labelled=False, dealt=dealt)
        model.move_topics()
        assert laid_by_item(model.rolling.last)
        assert model.document_counts().agg(F.sum("size")).first()[0] == tokens.count()
        found.append(sorted(map(tuple, model.tokens.collect())))
    assert found[0] == found[1]
    # counts by document need no exchange of the tokens
    assert exchanges(model.tokens.groupBy("item_id").count()) == 0


def test_every_document_is_read_back(spark, tmp_path):
    import hashlib

    from labelmesh.plans import preparing

    rows = [(1, "head\n\nbody\n", "en"), (2, None, "de"), (3, "line\n", None), (4, "", "en"), (4, "", "en"), (5, "a\r\n\r\nb\n\nc", "en"), (None, "7\n\nx", "en")]
    spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = [(1, "en", md5("body\n")), (2, "de", None), (3, None, md5("line\n")), (4, "en", md5("")), (4, "en", md5("")), (5, "en", md5("b\n\nc")), (None, "en", md5("x"))]
    got = preparing.read_documents(spark, str(tmp_path)).select("item_id", "gold", "text_md5")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
