"""Registered queries: sources, sinks and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmesh.models import topics
from labelmesh.operators import prep, votes
from labelmesh.plans import sqltext as S, views as V
from labelmesh.plans.registry import query
from labelmesh.runtime import shared_path
from labelmesh.sources import annotations as records, state

SEED = 7
#: for a file a row: tasks move files into place themselves, where one driver would do it file by file, and local files get
#: no checksum file beside them, whose permissions cost a process each
SMALL_FILES = {
    "mapreduce.fileoutputcommitter.algorithm.version": "2", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


@query("read_annotations", f"""WITH {S.ORDERS}
SELECT item_id, annotator_id AS annotator, label::VARCHAR AS annotation, o_orderkey AS start_time,
       NULL::VARCHAR AS gold FROM ev
UNION ALL
SELECT c_custkey, NULL, NULL, NULL, c_mktsegment FROM customer""")
def read_annotations(spark, sf):
    """Customers become label records, orders annotation records; written as JSON lines and read back."""
    labels = V.table(spark, sf, "customer").select(
        F.lit(0).alias("batch"), F.col("c_name").alias("data"), F.col("c_custkey").alias("source"),
        F.col("c_mktsegment").alias("label"), F.lit(None).cast("string").alias("annotation"),
        F.lit(None).cast("string").alias("annotator"), F.lit(0).cast("bigint").alias("startTime"),
        F.lit(0).cast("bigint").alias("endTime"),
    )
    marks = V.order_events(spark, sf).select(
        F.lit(1).alias("batch"), F.lit(None).cast("string").alias("data"), F.col("item_id").alias("source"),
        F.lit(None).cast("string").alias("label"), F.col("label").cast("string").alias("annotation"),
        F.col("annotator_id").alias("annotator"), F.col("o_orderkey").alias("startTime"),
        F.col("o_orderkey").alias("endTime"),
    )
    path = shared_path(spark, "records")
    marks.unionByName(labels).write.json(path)
    gold, events = records.read_annotations(spark, path)
    none = F.lit(None).cast("string")
    return events.select("item_id", "annotator", "annotation", "start_time", none.alias("gold")).unionByName(
        gold.select("item_id", none.alias("annotator"), none.alias("annotation"),
                    F.lit(None).cast("bigint").alias("start_time"), "gold")
    )


@query("read_documents", r"""SELECT doc_id AS item_id, lang AS gold, md5(regexp_replace(text, '(?s)\A.*?\r?\n\r?\n', '')) AS text_md5
FROM documents""")
def read_documents(spark, sf):
    """Every document written as a message in a file of its own in a folder of its class, and the folders read back.

    A message begins with the document's id and an empty line; one without the empty line has no text.
    """
    path, prefix = shared_path(spark, "texts"), "class="
    docs = prep.by_item(V.documents(spark, sf).select("item_id", "lang", "text"))  # every core writes its share of the files
    message = F.concat_ws("\n\n", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "text")
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("-")).alias("class"), message.alias("text"))
    texts.write.partitionBy("class").options(**SMALL_FILES).option("maxRecordsPerFile", 1).text(path)
    found = records.read_documents(spark, path, header=False)
    gold, item = F.substring("gold", len(prefix) + 1, 1 << 20), F.regexp_extract("text", r"\A(-?\d+)\n", 1)
    # the last line end is the writer's
    messages = found.select(
        F.when(item != "", item).cast(docs.schema["item_id"].dataType).alias("item_id"), F.when(gold != "-", gold).alias("gold"),
        F.regexp_extract("text", r"(?s)\A[^\n]+\n\n(.*)\n\z", 1).alias("body"), (F.instr("text", "\n\n") > 0).alias("some"))
    text = records.strip_header(messages.select("item_id", "gold", F.when(F.col("some"), F.col("body")).alias("text")))
    return text.select("item_id", "gold", F.md5("text").alias("text_md5"))


@query("index_labels", """SELECT event_id, event_type, (SELECT count(DISTINCT o.event_type) FROM events o WHERE o.event_type < e.event_type)::INT AS label FROM events e""")
def index_labels(spark, sf):
    """Event types numbered in their order."""
    return records.index_labels(V.table(spark, sf, "events").select("event_id", "event_type"), "event_type")[0]


def _saved_run(spark, sf):
    """A state to save: y = majority label of the part, m = a seeded uniform label, z = its labels in time order."""
    ev = V.line_events(spark, sf)
    y = votes.majority_vote(prep.compile_annotations(ev))
    m = prep.uniform_assignment(V.line_items(spark, sf), 3, SEED)
    return y.withColumnRenamed("label", "y").join(m.withColumnRenamed("label", "m"), "item_id", "full").withColumn(
        "z", F.array("y", "m")
    )


SAVED = f"""{S.LINE}, {S.MAJORITY},
saved AS (SELECT i.item_id, mj.label AS y, ({S.hash_int(str(SEED), 'i.item_id')} % 3)::INT AS m
          FROM items i LEFT JOIN maj mj ON mj.item_id = i.item_id)"""


@query("write_read_state", f"WITH {SAVED} SELECT item_id, y, m, y AS z0, m AS z1 FROM saved")
def write_read_state(spark, sf):
    path = shared_path(spark, "state")
    state.write_state(_saved_run(spark, sf), path, "json")
    return state.read_state(spark, path, "json").select(
        "item_id", "y", "m", F.col("z")[0].alias("z0"), F.col("z")[1].alias("z1")
    )


@query("state_from_predictions", f"""WITH {S.ORDERS}, {S.MAJORITY}
SELECT item_id, label AS y, 2 - label AS m, 0 AS z_size FROM maj""")
def state_from_predictions(spark, sf):
    predicted = votes.majority_vote(V.order_annotations(spark, sf)).withColumn("alternative", 2 - F.col("label"))
    return state.state_from_predictions(predicted).select(
        "item_id", "y", "m", F.coalesce(F.size("z"), F.lit(0)).alias("z_size")
    ).withColumn("z_size", F.greatest("z_size", F.lit(0)))


_TOKEN_Z = f"{S.hash_int(str(SEED), 'item_id', 'pos')} % 6"


@query("token_state", f"""WITH {S.TOKENS}
SELECT d.doc_id AS item_id, l.quality AS y, string_agg(({_TOKEN_Z})::VARCHAR, ',' ORDER BY pos) AS z
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN tok t ON t.item_id = d.doc_id GROUP BY d.doc_id, l.quality""")
def token_state(spark, sf):
    """Topics of every token saved with the items' labels, read back, turned into tokens and joined into arrays again."""
    tokens = topics.start_topics(prep.tokenize(V.documents(spark, sf)), 6, SEED)
    predicted = V.doc_items(spark, sf).select("item_id", F.col("observed_label").alias("label"), F.lit(None).cast("int").alias("alternative"))
    path = shared_path(spark, "state")
    state.write_state(state.state_from_predictions(predicted, tokens=tokens), path)
    saved = state.read_state(spark, path)
    again = state.token_state(state.topics_of_state(saved), chunk=1000)
    return saved.select("item_id", "y").join(again, "item_id", "left").select("item_id", "y", F.concat_ws(",", F.transform("z", lambda x: x.cast("string"))).alias("z"))


@query("predictions_table", f"""WITH {S.DOC_ITEMS}, {S.LABEL_ANN}
SELECT item_id, ({S.hash_int(str(SEED), 'item_id')} % 2)::INT AS label,
  CASE WHEN item_id IN (SELECT item_id FROM ann) THEN 'labeled' ELSE 'unlabeled' END AS split
FROM items WHERE {S.hash_int('1', 'item_id')} % 100 < 85
UNION ALL
SELECT item_id, ({S.hash_int(str(SEED), 'item_id')} % 2)::INT, 'heldout'
FROM items WHERE {S.hash_int('1', 'item_id')} % 100 >= 85""")
def predictions_table(spark, sf):
    train, heldout = prep.train_heldout_split(V.doc_items(spark, sf), 85, 1)
    return state.predictions_table(
        prep.uniform_assignment(train, 2, SEED), V.label_annotations(spark, sf),
        prep.uniform_assignment(heldout, 2, SEED),
    )


@query("compile_annotations", f"WITH {S.LINE} SELECT * FROM ann")
def compile_annotations(spark, sf):
    return V.line_annotations(spark, sf)


@query("split_annotated", f"""WITH {S.DOC_ITEMS}, {S.LABEL_ANN}
SELECT item_id, item_id IN (SELECT item_id FROM ann) AS annotated FROM items""")
def split_annotated(spark, sf):
    some, none = prep.split_annotated(V.doc_items(spark, sf).select("item_id"), V.label_annotations(spark, sf))
    return some.withColumn("annotated", F.lit(True)).unionByName(none.withColumn("annotated", F.lit(False)))


@query("split_observed", f"""WITH {S.DOC_ITEMS}
SELECT item_id, observed_label, observed_label IS NOT NULL AS observed FROM items""")
def split_observed(spark, sf):
    seen, unseen = prep.split_observed(V.doc_items(spark, sf))
    return seen.withColumn("observed", F.lit(True)).unionByName(unseen.withColumn("observed", F.lit(False)))


@query("item_weights", f"""WITH {S.DOC_ITEMS}, {S.LABEL_ANN}
SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM ann) THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS weight
FROM items""")
def item_weights(spark, sf):
    items = V.doc_items(spark, sf).select("item_id")
    return prep.item_weights(items, V.label_annotations(spark, sf), "0.25")


@query("overlay_observed", f"""WITH {S.DOC_ITEMS}
SELECT item_id, coalesce(observed_label, ({S.hash_int(str(SEED), 'item_id')} % 2)::INT) AS label FROM items""")
def overlay_observed(spark, sf):
    items = V.doc_items(spark, sf)
    return prep.overlay_observed(prep.uniform_assignment(items, 2, SEED), items)


@query("backoff_state", f"""WITH {S.DOC_ITEMS}
SELECT item_id, coalesce(observed_label, ({S.hash_int(str(SEED), 'item_id')} % 2)::INT) AS y,
       coalesce(1 - observed_label, ({S.hash_int(str(SEED), 'item_id')} % 2)::INT) AS m FROM items""")
def backoff_state(spark, sf):
    items = V.doc_items(spark, sf)
    saved = V.label_annotations(spark, sf).select(
        "item_id", F.col("label").alias("y"), (1 - F.col("label")).alias("m")
    )
    return prep.backoff_state(items, saved, prep.uniform_assignment(items, 2, SEED))


#: corpus count at or below which bag_of_words drops a word
WORD_CUTOFF = 5


@query("bag_of_words", f"WITH {S.features(WORD_CUTOFF)} SELECT * FROM feat")
def bag_of_words(spark, sf):
    return V.doc_features(spark, sf, WORD_CUTOFF)


@query("doc_size", f"WITH {S.features()} SELECT item_id, sum(value) AS size FROM feat GROUP BY 1")
def doc_size(spark, sf):
    return prep.doc_size(V.doc_features(spark, sf))


def emb_long(spark, sf):
    return V.emb_items(spark, sf).select("item_id", F.posexplode("location").alias("feature", "v")).select(
        "item_id", "feature", F.col("v").cast("double").alias("value")
    )


EMB_LONG = """f AS (SELECT vec_id AS item_id, (generate_subscripts(embedding, 1) - 1)::INT AS feature,
  unnest(embedding)::DOUBLE AS value FROM embeddings)"""


@query("rescale_features", f"""WITH {EMB_LONG}, b AS (SELECT min(value) AS lo, max(value) AS hi FROM f)
SELECT item_id, feature, round(CASE WHEN lo < 0 THEN (value - lo) / (hi - lo) * 100 ELSE value END, 6) AS value
FROM f, b""")
def rescale_features(spark, sf):
    return prep.rescale_features(emb_long(spark, sf)).withColumn("value", F.round("value", 6))


@query("train_heldout_split", f"""WITH {S.DOC_ITEMS}
SELECT item_id, {S.hash_int(str(SEED), 'item_id')} % 100 < 85 AS train FROM items""")
def train_heldout_split(spark, sf):
    train, heldout = prep.train_heldout_split(V.doc_items(spark, sf).select("item_id"), 85, SEED)
    return train.withColumn("train", F.lit(True)).unionByName(heldout.withColumn("train", F.lit(False)))


@query("perturb_labels", f"""WITH {S.LINE}, {S.MAJORITY}
SELECT item_id, CASE WHEN {S.uniform(f'{SEED}-hit', 'item_id')} < 0.8
  THEN ({S.hash_int(f'{SEED}-new', 'item_id')} % 3)::INT ELSE label END AS label FROM maj""")
def perturb_labels(spark, sf):
    return prep.perturb_labels(votes.majority_vote(V.line_annotations(spark, sf)), 3, 0.8, SEED)


@query("uniform_assignment", f"""WITH {S.LINE}
SELECT item_id, ({S.hash_int(str(SEED), 'item_id')} % 3)::INT AS label FROM items""")
def uniform_assignment(spark, sf):
    return prep.uniform_assignment(V.line_items(spark, sf), 3, SEED)


@query("attach_saved_labels", f"""WITH {S.LINE}, {S.MAJORITY} SELECT item_id, label FROM maj""")
def attach_saved_labels(spark, sf):
    ann = V.line_annotations(spark, sf)
    saved = votes.majority_vote(ann).withColumnRenamed("label", "y")
    return prep.attach_saved_labels(ann.select("item_id").distinct(), saved)


@query("concat_predictions", f"""WITH {S.DOC_ITEMS}, {S.LABEL_ANN}
SELECT item_id, label, 'labeled' AS part FROM ann
UNION ALL SELECT item_id, ({S.hash_int(str(SEED), 'item_id')} % 2)::INT, 'unlabeled' FROM items
WHERE item_id NOT IN (SELECT item_id FROM ann)""")
def concat_predictions(spark, sf):
    ann = V.label_annotations(spark, sf)
    _, rest = prep.split_annotated(V.doc_items(spark, sf), ann)
    return prep.concat_predictions(
        ann.select("item_id", "label", F.lit("labeled").alias("part")),
        prep.uniform_assignment(rest, 2, SEED).withColumn("part", F.lit("unlabeled")),
    )


@query("known_items", f"""WITH {S.ORDERS}, {S.MAJORITY}
SELECT item_id, label FROM maj WHERE item_id IN (SELECT l_partkey FROM lineitem)""")
def known_items(spark, sf):
    """Customer predictions kept only where the id is also a line item's part."""
    known = V.line_events(spark, sf).select("item_id")
    return prep.known_items(votes.majority_vote(V.order_annotations(spark, sf)), known)


@query("nth_annotation", f"""WITH {S.LINE_EVENTS}
SELECT item_id, annotator_id, label, l_orderkey, l_linenumber,
  row_number() OVER (PARTITION BY item_id, annotator_id ORDER BY ts, l_orderkey, l_linenumber, label)::INT AS nth
FROM ev""")
def nth_annotation(spark, sf):
    ranked = prep.nth_annotation(V.line_events(spark, sf), ["ts", "l_orderkey", "l_linenumber", "label"])
    return ranked.select("item_id", "annotator_id", "label", "l_orderkey", "l_linenumber", "nth")
