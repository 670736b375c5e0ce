"""Learning loops over the driver tables: labels for documents, events as outcomes of strategies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftline.operators import learning, tables as jobs
from siftline.plans.ordering import _INFORMATIVENESS, event_scores
from siftline.plans.registry import query
from siftline.session import ensure_checkpoint_dir, spread


def labelled(t):
    return t.texts.select("doc_id", "text").join(
        t.labels.select("doc_id", (F.col("quality") == 1).cast("int").alias("label")), "doc_id"
    )


def _metric_row(t, kind):
    model, scores = learning.train(labelled(t), "doc_id", "text", "label", kind)
    rows = [(kind, name, float(value)) for name, value in scores.items() if not isinstance(value, str)]
    return t.spark.createDataFrame(rows, "model STRING, metric STRING, value DOUBLE"), model


@query("ml_tfidf_lr_train")
def ml_tfidf_lr_train(t):
    return _metric_row(t, "logistic")[0]


@query("ml_predict")
def ml_predict(t):
    model, _ = learning.train(labelled(t), "doc_id", "text", "label")
    scored = learning.predict(model, t.texts.select("doc_id", "text"))
    return scored.select("doc_id", F.round("probability", 6).alias("probability"), "is_lead", "method")


@query("ml_save_load", "SELECT doc_id, true AS same FROM documents")
def ml_save_load(t):
    """Predictions of the model that was trained, against those of the model written and read again."""
    model, _ = learning.train(labelled(t), "doc_id", "text", "label")
    again = learning.saved(model, f"{ensure_checkpoint_dir(t.spark)}/model-{uuid.uuid4().hex}")
    rows = t.texts.select("doc_id", "text")
    one = learning.predict(model, rows).select("doc_id", F.col("probability").alias("p"))
    two = learning.predict(again, rows).select("doc_id", F.col("probability").alias("q"))
    return one.join(two, "doc_id").select("doc_id", F.col("p").eqNullSafe(F.col("q")).alias("same"))


@query("ml_second_committee_member")
def ml_second_committee_member(t):
    return _metric_row(t, "bayes")[0]


@query(
    "ml_metrics",
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp,
                         count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn
                  FROM labels)
       SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6)::DOUBLE AS accuracy,
              round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / (tp + fn), 6)::DOUBLE AS recall,
              round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM c""",
)
def ml_metrics(t):
    """Quality is the truth, absence of toxicity the prediction."""
    return learning.metrics(t.labels, F.col("quality") == 1, F.col("toxic") == 0)


@query("al_informativeness", f"WITH {_INFORMATIVENESS} SELECT event_id, informativeness FROM i")
def al_informativeness(t):
    return learning.informativeness(event_scores(t), "event_id")


@query(
    "al_unlabelled_pool",
    """SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL""",
)
def al_unlabelled_pool(t):
    done = t.labels.filter(F.col("quality").isNotNull())
    return t.documents.select("doc_id", "source").join(done, "doc_id", "left_anti")


@query(
    "al_select_batch",
    f"""WITH {_INFORMATIVENESS}, pick AS (SELECT event_id FROM (
          SELECT * FROM i WHERE event_type = 'click') ORDER BY informativeness DESC, event_id LIMIT 50)
        SELECT event_id, event_id IN (SELECT event_id FROM pick) AS needs_review FROM events""",
)
def al_select_batch(t):
    """The event table with the selected rows marked for review."""
    scored = learning.informativeness(event_scores(t), "event_id", ["event_type"])
    batch = learning.select_batch(scored, F.col("event_type") == "click", "event_id").select(
        "event_id", F.lit(True).alias("picked")
    )
    return t.events.select("event_id").join(batch, "event_id", "left").select(
        "event_id", F.coalesce("picked", F.lit(False)).alias("needs_review")
    )


@query(
    "al_apply_labels",
    """SELECT d.doc_id, CASE l.quality WHEN 1 THEN true WHEN 0 THEN false END AS manual_label,
              CASE WHEN l.doc_id IS NOT NULL THEN 'reviewer' END AS labeled_by, l.doc_id IS NULL AS needs_review,
              CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 1 THEN 'accepted' ELSE 'rejected' END AS status
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def al_apply_labels(t):
    rows = t.documents.select(
        "doc_id", F.lit(None).cast("boolean").alias("manual_label"), F.lit(None).cast("string").alias("labeled_by"),
        F.lit(True).alias("needs_review"), F.lit("new").alias("status"),
    )
    good = F.col("quality") == 1
    verdicts = t.labels.select(
        "doc_id", good.alias("manual_label"), F.lit("reviewer").alias("labeled_by"),
        F.lit(False).alias("needs_review"), F.when(good, "accepted").otherwise("rejected").alias("status"),
    )
    return jobs.patch(rows, verdicts, "doc_id", ["manual_label", "labeled_by", "needs_review", "status"])


@query(
    "al_labelled_set",
    "SELECT md5(text) AS text_key, quality = 1 AS is_lead FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def al_labelled_set(t):
    truth = t.labels.filter(F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 1).alias("is_lead"))
    return t.documents.join(truth, "doc_id").select(F.md5("text").alias("text_key"), "is_lead")


@query("al_retrain_gate", "SELECT count(*) AS labelled, count(*) >= 50 AS retrain FROM labels WHERE quality IS NOT NULL")
def al_retrain_gate(t):
    return learning.retrain_due(t.labels.filter(F.col("quality").isNotNull()))


_REWARD = """CASE WHEN event_type = 'error' THEN 0.0 ELSE 0.3 + CASE WHEN value > 0 AND value * 60 < 3600 THEN 0.1 ELSE 0 END
  + CASE WHEN user_id >= 100 THEN 0.2 WHEN user_id >= 50 THEN 0.1 ELSE 0 END
  + CASE WHEN event_type = 'purchase' THEN 1.0 + CASE WHEN value * 1000 > 50000 THEN 0.5
      WHEN value * 1000 > 20000 THEN 0.2 ELSE 0 END ELSE 0 END END"""


def outcomes(t):
    value = F.col("value")
    length = F.when(F.col("user_id") >= 100, 5).when(F.col("user_id") >= 50, 3).otherwise(1)
    gain = learning.reward(
        F.col("event_type") != "error", value * 60, length, F.col("event_type") == "purchase", value * 1000
    )
    return t.events.select("event_id", F.col("event_type").alias("strategy_id"), gain.alias("reward"))


@query("bandit_reward", f"SELECT event_id, event_type AS strategy_id, round(({_REWARD})::DOUBLE, 6) AS reward FROM events")
def bandit_reward(t):
    return outcomes(t).select("event_id", "strategy_id", F.round("reward", 6).alias("reward"))


@query(
    "bandit_posterior",
    f"""WITH r AS (SELECT event_type AS strategy_id, ({_REWARD})::DOUBLE AS reward FROM events)
        SELECT strategy_id, 1.0::DOUBLE + count(*) FILTER (reward > 0) AS alpha,
               1.0::DOUBLE + count(*) FILTER (reward <= 0) AS beta, count(*) AS total_attempts,
               count(*) FILTER (reward > 0) AS successful_attempts, round(avg(reward), 6) AS avg_reward
        FROM r GROUP BY 1""",
)
def bandit_posterior(t):
    priors = t.events.select(F.col("event_type").alias("strategy_id")).distinct().select(
        "strategy_id", F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta"),
        F.lit(0).cast("long").alias("total_attempts"), F.lit(0).cast("long").alias("successful_attempts"),
        F.lit(0.0).alias("avg_reward"),
    )
    return learning.posterior(priors, outcomes(t), "strategy_id").withColumn("avg_reward", F.round("avg_reward", 6))


ARMS = [("direct", 12.0, 8.0), ("technical", 9.0, 9.0), ("friendly", 5.0, 7.0)]


SEED = 42


def _uniform_sql(*parts: str) -> str:
    joined = " || ':' || ".join([f"'{SEED}'", *parts])
    return f"((('0x' || substr(md5(o_orderkey || ':' || {joined}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


_DRAWS = ", ".join(f"('{name}/{side}', '{name}', '{side}', {shape - 1 / 3!r})" for name, a, b in ARMS for side, shape in (("a", a), ("b", b)))
_ORDER = ", ".join(f"('{name}', {i})" for i, (name, _, _) in enumerate(ARMS))


@query(
    "bandit_select",
    f"""WITH draw(purpose, strategy, side, d) AS (VALUES {_DRAWS}), place(strategy, n) AS (VALUES {_ORDER}),
            attempt AS (SELECT o_orderkey, purpose, strategy, side, d::DOUBLE AS d, i,
                               sqrt(-2 * ln({_uniform_sql("purpose", "i", "'0'")})) * cos({2 * 3.141592653589793!r} * {_uniform_sql("purpose", "i", "'1'")}) AS z,
                               {_uniform_sql("purpose", "i", "'2'")} AS u
                        FROM orders, draw, (SELECT unnest(range({learning.ATTEMPTS})) AS i)),
            cubed AS (SELECT *, pow(1 + (1 / sqrt(9 * d)) * z, 3.0) AS v FROM attempt),
            taken AS (SELECT o_orderkey, strategy, side,
                             coalesce(arg_min(d * v, i) FILTER (v > 0 AND ln(u) < z * z / 2 + d - d * v + d * ln(CASE WHEN v > 0 THEN v END)), any_value(d) + 1.0 / 3) AS g
                      FROM cubed GROUP BY ALL),
            ratio AS (SELECT o_orderkey, strategy, max(g) FILTER (side = 'a') / (max(g) FILTER (side = 'a') + max(g) FILTER (side = 'b')) AS share FROM taken GROUP BY ALL),
            best AS (SELECT r.o_orderkey, arg_max(r.strategy, (round(share * CASE
                            WHEN r.strategy = 'technical' AND o_orderpriority = '1-URGENT' THEN 1.2
                            WHEN r.strategy = 'direct' AND o_totalprice > 400000 THEN 1.1 ELSE 1.0 END, 9), -n)) AS strategy
                     FROM ratio r JOIN orders o ON o.o_orderkey = r.o_orderkey JOIN place p ON p.strategy = r.strategy GROUP BY r.o_orderkey),
            free AS (SELECT o_orderkey, {_uniform_sql("'explore'")} < 0.2 AS explored, floor({_uniform_sql("'any'")} * {len(ARMS)}) AS pick FROM orders)
       SELECT f.o_orderkey, explored, CASE WHEN explored THEN (SELECT strategy FROM place WHERE n = pick) ELSE b.strategy END AS strategy
       FROM free f JOIN best b ON b.o_orderkey = f.o_orderkey""",
)
def bandit_select(t):
    """A strategy per order; large orders favour ``direct``, building customers ``technical``."""
    boosts = {
        "technical": F.when(F.col("o_orderpriority") == "1-URGENT", 1.2).otherwise(1.0),
        "direct": F.when(F.col("o_totalprice") > 400000, 1.1).otherwise(1.0),
    }
    chosen = learning.sample_strategy(spread(t.orders), "o_orderkey", ARMS, boosts, seed=SEED)
    return chosen.select("o_orderkey", "explored", "strategy")


_MEANS = ", ".join(f"('{name}', {i}, {a / (a + b)})" for i, (name, a, b) in enumerate(ARMS))


@query(
    "bandit_select_mean",
    f"""WITH arm(strategy, n, mean) AS (VALUES {_MEANS}),
            v AS (SELECT o_orderkey, strategy, n, mean * CASE
                         WHEN strategy = 'technical' AND o_orderpriority = '1-URGENT' THEN 1.2
                         WHEN strategy = 'direct' AND o_totalprice > 400000 THEN 1.1 ELSE 1.0 END AS value FROM orders, arm)
       SELECT o_orderkey, arg_max(strategy, (round(value::DOUBLE, 9), -n)) AS strategy FROM v GROUP BY o_orderkey""",
)
def bandit_select_mean(t):
    """The same choice by posterior means instead of samples."""
    boosts = {
        "technical": F.when(F.col("o_orderpriority") == "1-URGENT", 1.2).otherwise(1.0),
        "direct": F.when(F.col("o_totalprice") > 400000, 1.1).otherwise(1.0),
    }
    return t.orders.select("o_orderkey", learning.best_by_mean(ARMS, boosts).alias("strategy"))


@query(
    "bandit_context_log",
    """SELECT o_orderkey, o_orderpriority AS priority, o_totalprice AS budget, coalesce(o_orderstatus, 'unknown') AS category,
              CAST(hour(o_orderdate) AS INTEGER) AS time_of_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week
       FROM orders""",
)
def bandit_context_log(t):
    return t.orders.select(
        "o_orderkey",
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("budget"),
        F.coalesce("o_orderstatus", F.lit("unknown")).alias("category"),
        F.hour("o_orderdate").alias("time_of_day"),
        F.weekday("o_orderdate").alias("day_of_week"),
    )
