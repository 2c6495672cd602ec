"""Registered queries: the events table as a stream of annotations, run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmesh.models import scoring, variational as M
from labelmesh.operators import prep
from labelmesh.plans import modelsql as Q, sqltext as S, views as V
from labelmesh.plans.registry import query
from labelmesh.plans.voting import long_p
from labelmesh.priors import Priors
from labelmesh.runtime import shared_path
from labelmesh.sources.models import load_model, save_model
from labelmesh.streaming import annotations as stream

P = Priors()
WINDOW, DELAY = "1 day", "6 hours"

EVENTS = """ev AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS item_id, user_id AS annotator_id,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS label, ts
  FROM events),
ann AS (SELECT item_id, annotator_id, label, count(*)::BIGINT AS n FROM ev GROUP BY ALL),
items AS (SELECT DISTINCT item_id FROM ev)"""


def event_stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return V.event_annotations(raw).withColumn("ts", F.col("ts").cast("timestamp"))


@query("running_vote", f"WITH {EVENTS}, {S.MAJORITY} SELECT item_id, label FROM maj")
def running_vote(spark, sf):
    out = shared_path(spark, "running_vote")
    stream.running_vote(event_stream(spark, sf), 5, out, f"{out}-state").awaitTermination()
    return stream.current_votes(spark, out)


@query("windowed_annotator_activity", f"""WITH {EVENTS}, k AS {S.classes(5)},
w AS (SELECT annotator_id, time_bucket(INTERVAL 1 DAY, ts) AS b, label FROM ev),
t AS (SELECT annotator_id, b, count(*) AS n FROM w GROUP BY 1, 2)
SELECT t.annotator_id, strftime(t.b, '%Y-%m-%d %H:%M') AS start, t.n::BIGINT AS n, k.truth AS label,
  round((SELECT count(*) FROM w WHERE w.annotator_id = t.annotator_id AND w.b = t.b AND w.label = k.truth) / t.n::DOUBLE, 6) AS share
FROM t CROSS JOIN k WHERE t.b + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)""")
def windowed_annotator_activity(spark, sf):
    out = shared_path(spark, "activity")
    activity = stream.windowed_activity(event_stream(spark, sf), 5, WINDOW, DELAY)
    stream.write_windows(activity, out, f"{out}-state").awaitTermination()
    return spark.read.schema(activity.schema).parquet(out).select(
        "annotator_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n",
        F.posexplode("share").alias("label", "share"),
    ).withColumn("share", F.round("share", 6))


@query("stream_score", f"""WITH {EVENTS}, {Q.variational(5, 1, False, P)},
lw AS (SELECT annotator_id, truth, label, ln(v / sum(v) OVER (PARTITION BY annotator_id, truth)) AS w FROM (
  SELECT j.annotator_id, k.truth, l.truth AS label, {S.prior_cell(*P.with_(c_gamma=1.0).annotator_cell(5), 'k.truth', 'l.truth')}
    + coalesce(s.c, 0) AS v
  FROM (SELECT DISTINCT annotator_id FROM ann) j CROSS JOIN k CROSS JOIN k l LEFT JOIN (
    SELECT a.annotator_id, a.label, g.truth, sum(a.n * g.g) AS c FROM ann a JOIN g1 g ON g.item_id = a.item_id
    GROUP BY a.annotator_id, a.label, g.truth) s ON s.annotator_id = j.annotator_id AND s.truth = k.truth AND s.label = l.truth)),
th AS (SELECT truth, ln(pi / sum(pi) OVER ()) AS w FROM (SELECT truth, {P.b_theta} + sum(g) AS pi FROM g1 GROUP BY truth)),
sc AS (SELECT a.item_id, lw.truth, any_value(th.w) + sum(a.n * lw.w) AS score FROM ann a
  JOIN lw ON lw.annotator_id = a.annotator_id AND lw.label = a.label JOIN th ON th.truth = lw.truth GROUP BY a.item_id, lw.truth),
{Q.softmax('res', 'sc', 'score')}
SELECT item_id, truth, round(g, 6) AS p FROM res""")
def stream_score(spark, sf):
    """A model fitted on the events as a batch, saved and loaded, scores the same events as they stream in."""
    batch = prep.compile_annotations(V.event_annotations(V.table(spark, sf, "events")))
    saved = shared_path(spark, "model")
    save_model(spark, scoring.point_model(M.item_resp_vb(batch, batch.select("item_id").distinct(), 5, P, 1)), saved)
    model = load_model(spark, saved)
    out = shared_path(spark, "stream_score")
    stream.stream_score(event_stream(spark, sf), model, out, f"{out}-state").awaitTermination()
    return long_p(stream.current_scores(spark, out, model))
