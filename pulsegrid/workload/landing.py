"""Payload flattening, schema evolution, upserts, incremental work lists, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import entities as E
from ..sources import payloads as P
from ..sources import sinks as K
from ..streaming import upsert as U
from .frames import Frames
from .registry import query

K_ = "o_orderkey"
_ORDERS = "(SELECT c_nationkey AS profile_id, CAST(o_orderdate AS DATE) AS date, o_orderkey AS k FROM customer_orders)"


def _sparse(payload: str, filled: str) -> str:
    """The payload where the condition holds, an empty document elsewhere."""
    return f"if({filled}, {payload}, '{{}}')"


def landed(f: Frames, endpoint: str, payload: str) -> DataFrame:
    """Orders as landed payloads: one JSON text per order of the given shape."""
    return f.customer_orders.selectExpr(
        "c_nationkey AS profile_id",
        f"'{endpoint}' AS endpoint",
        "CAST(o_orderdate AS DATE) AS key_date",
        f"{K_} AS activity_id",
        f"{payload} AS payload",
        f"{K_} AS ingest_seq",
    )


# --------------------------------------------------------------- daily health
SUMMARY = f"""to_json(named_struct('totalSteps', {K_} * 2, 'restingHeartRate', {K_} % 100 + 0.7e0, 'averageStressLevel', {K_} % 60 - 5, 'maxStressLevel', {K_} % 80 - 2,
  'sleepingSeconds', 20000 + {K_} % 1000, 'bodyBatteryAtWakeTime', {K_} % 100, 'bodyBatteryMostRecentValue', if({K_} % 7 = 0, null, {K_} % 90), 'avgWakingRespirationValue', 12.5e0, 'totalKilocalories', 2000.9e0))"""
SLEEP_BODY = f"""named_struct('sleepTimeSeconds', if({K_} % 3 = 0, null, 25000 + {K_} % 500), 'deepSleepSeconds', if({K_} % 9 = 0, null, 4000), 'lightSleepSeconds', 15000 + {K_} % 50, 'remSleepSeconds', 5000,
  'sleepScores', named_struct('overall', named_struct('value', {K_} % 100)))"""
SLEEP = f"if({K_} % 4 = 0, to_json(named_struct('dailySleepDTO', {SLEEP_BODY})), to_json({SLEEP_BODY}))"
HRV = f"to_json(named_struct('hrvSummary', named_struct('weeklyAvg', 50 + {K_} % 9, 'lastNight', if({K_} % 2 = 1, null, 40 + {K_} % 7), 'lastNightAvg', 30 + {K_} % 7, 'status', 'BALANCED')))"


@query(
    "flatten_daily_health",
    "profile_id, date:d, steps:i, total_calories:i, resting_hr:i, sleep_seconds:i, deep_sleep_seconds:i, sleep_score:i, avg_stress:i, max_stress:i, body_battery_start:i, body_battery_end:i, "
    "hrv_last_night:i, hrv_weekly_avg:i, hrv_status, avg_respiration:2, hydration_ml:i",
    f"""SELECT profile_id, date, a * 2 AS steps, 2000 AS total_calories, a % 100 AS resting_hr,
          coalesce(CASE WHEN b % 3 <> 0 THEN 25000 + b % 500 WHEN b % 9 <> 0 THEN 4000 + 15000 + b % 50 + 5000 END, 20000 + a % 1000) AS sleep_seconds,
          CASE WHEN b % 9 <> 0 THEN 4000 END AS deep_sleep_seconds, b % 100 AS sleep_score, CASE WHEN a % 60 >= 5 THEN a % 60 - 5 END AS avg_stress, CASE WHEN a % 80 >= 2 THEN a % 80 - 2 END AS max_stress,
          a % 100 AS body_battery_start, CASE WHEN a % 7 <> 0 THEN a % 90 END AS body_battery_end,
          CASE WHEN c % 2 = 1 THEN 30 + c % 7 ELSE 40 + c % 7 END AS hrv_last_night, 50 + c % 9 AS hrv_weekly_avg, CASE WHEN c IS NOT NULL THEN 'BALANCED' END AS hrv_status,
          12.5e0 AS avg_respiration, NULL AS hydration_ml
        FROM (SELECT profile_id, date, a, CASE WHEN a % 2 = 0 THEN a END AS b, CASE WHEN a % 3 = 0 THEN a END AS c FROM (SELECT profile_id, date, max(k) AS a FROM {_ORDERS} GROUP BY 1, 2))""",
)
def flatten_daily_health(f: Frames) -> DataFrame:
    raw = landed(f, P.SUMMARY, SUMMARY).unionByName(landed(f, P.SLEEP, _sparse(SLEEP, f"{K_} % 2 = 0"))).unionByName(landed(f, P.HRV, _sparse(HRV, f"{K_} % 3 = 0")))
    return P.flatten_daily_health(raw)


VO2 = f"if({K_} % 2 = 0, to_json(array(named_struct('generic', named_struct('vo2MaxValue', 40.5e0, 'fitnessAge', {K_} % 30)))), to_json(named_struct('generic', named_struct('vo2MaxValue', 41.5e0, 'fitnessAge', {K_} % 30))))"
STATUS = f"""if({K_} % 2 = 0,
  to_json(named_struct('mostRecentTrainingStatus', named_struct('latestTrainingStatusData', map('3497', named_struct('calendarDate', if({K_} % 4 = 0, '1900-01-01', date_format(o_orderdate, 'yyyy-MM-dd')), 'trainingStatusFeedbackPhrase', concat('PHRASE_', {K_} % 5)))))),
  to_json(named_struct('trainingStatusHistory', array(named_struct('calendarDate', '1900-01-01', 'trainingStatusFeedbackPhrase', 'OLD'), named_struct('calendarDate', date_format(o_orderdate, 'yyyy-MM-dd'), 'trainingStatusFeedbackPhrase', 'HISTORY')))))"""


@query(
    "flatten_performance",
    "profile_id, date:d, vo2max:2, fitness_age:i, training_readiness:i, training_status, race_5k_sec:i, race_marathon_sec:i, endurance_score:i, hill_score:i",
    f"""SELECT profile_id, date, CASE WHEN v % 2 = 0 THEN 40.5e0 WHEN v % 2 = 1 THEN 41.5e0 END AS vo2max, coalesce(CAST(30 + floor(g % 10 / 2 + 0.5) AS INT), v % 30) AS fitness_age, t % 100 AS training_readiness,
          CASE WHEN s % 4 = 0 THEN NULL WHEN s % 2 = 0 THEN 'PHRASE_' || CAST(s % 5 AS STRING) WHEN s IS NOT NULL THEN 'HISTORY' END AS training_status,
          r % 1500 AS race_5k_sec, NULL AS race_marathon_sec, e AS endurance_score, NULL AS hill_score
        FROM (SELECT profile_id, date, CASE WHEN r % 3 > 0 THEN r END AS v, CASE WHEN r % 5 = 0 THEN r END AS g, CASE WHEN r % 7 < 4 THEN r END AS t, CASE WHEN r % 2 = 0 OR r % 3 = 0 THEN r END AS s, r, CASE WHEN r % 11 = 0 THEN r END AS e
              FROM (SELECT profile_id, date, max(k) AS r FROM {_ORDERS} GROUP BY 1, 2))""",
)
def flatten_performance(f: Frames) -> DataFrame:
    parts = [
        landed(f, P.VO2, _sparse(VO2, f"{K_} % 3 > 0")),
        landed(f, P.FITNESS_AGE, _sparse(f"to_json(named_struct('fitnessAge', 30 + ({K_} % 10) / 2e0))", f"{K_} % 5 = 0")),
        landed(f, P.READINESS, _sparse(f"to_json(array(named_struct('score', {K_} % 100), named_struct('score', -1)))", f"{K_} % 7 < 4")),
        landed(f, P.STATUS, _sparse(STATUS, f"{K_} % 2 = 0 OR {K_} % 3 = 0")),
        landed(f, P.RACE, f"to_json(array(named_struct('time5K', {K_} % 1500, 'timeMarathon', 'text')))"),
        landed(f, P.ENDURANCE, _sparse(f"to_json(named_struct('overallScore', {K_}))", f"{K_} % 11 = 0")),
    ]
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p)
    return P.flatten_performance(raw)


WEIGHED = f"named_struct('calendarDate', if({K_} % 5 = 0, null, date_format(o_orderdate, 'yyyy-MM-dd')), 'date', if({K_} % 3 = 0, null, 1000 * {K_}), 'timestampGMT', 'fallback', 'samplePk', {K_}, 'weight', 70000.5e0, 'physiqueRating', 3)"
WEIGHT = f"""CASE {K_} % 4 WHEN 0 THEN to_json(named_struct('dailyWeightSummaries', array(named_struct('summaryDate', date_format(o_orderdate, 'yyyy-MM-dd'), 'allWeightMetrics', array({WEIGHED}, {WEIGHED}), 'latestWeight', {WEIGHED}))))
  WHEN 1 THEN to_json(named_struct('dailyWeightSummaries', array(named_struct('summaryDate', date_format(o_orderdate, 'yyyy-MM-dd'), 'latestWeight', {WEIGHED}))))
  WHEN 2 THEN concat('{{"dailyWeightSummaries":[{{"summaryDate":"2000-01-01","allWeightMetrics":[],"latestWeight":', to_json({WEIGHED}), '}}]}}') ELSE '{{}}' END"""


@query(
    "flatten_weight",
    "profile_id, date:d, timestamp_gmt, sample_pk:i, weight_kg:5, weight_grams:2, physique_rating:i",
    f"""SELECT profile_id, date, CASE WHEN k % 3 = 0 THEN 'fallback' ELSE strftime(make_timestamp(k * 1000000), '%Y-%m-%dT%H:%M:%S') END AS timestamp_gmt, k AS sample_pk, 70.0005e0 AS weight_kg, 70000.5e0 AS weight_grams, 3 AS physique_rating
        FROM (SELECT profile_id, date, max(k) AS k FROM {_ORDERS} GROUP BY 1, 2), LATERAL (SELECT unnest(CASE k % 4 WHEN 0 THEN [1, 2] WHEN 1 THEN [1] ELSE [] END) AS copy)""",
)
def flatten_weight(f: Frames) -> DataFrame:
    return P.flatten_weight(landed(f, P.WEIGHT, WEIGHT))


READING = f"named_struct('measurementTimestampLocal', if({K_} % 5 = 0, null, concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T07:00:00')), 'measurementTimestampGMT', if({K_} % 3 = 0 AND {K_} % 5 <> 0, null, '2000-02-03T05:00:00'), 'systolic', 100 + {K_} % 50, 'diastolic', 70.5e0, 'categoryName', 'NORMAL')"
BP = f"""CASE {K_} % 3 WHEN 0 THEN to_json(named_struct('measurementSummaries', array(named_struct('measurements', array({READING}, {READING})), named_struct('measurements', array({READING})))))
  WHEN 1 THEN to_json(array({READING})) ELSE '{{"other":1}}' END"""


@query(
    "flatten_blood_pressure",
    "profile_id, date:d, timestamp_gmt, timestamp_local, systolic:i, diastolic:i, category_name",
    f"""SELECT profile_id, CASE WHEN k % 5 = 0 THEN DATE '2000-02-03' ELSE date END AS date,
          CASE WHEN k % 3 = 0 AND k % 5 <> 0 THEN CAST(date AS STRING) || 'T07:00:00' ELSE '2000-02-03T05:00:00' END AS timestamp_gmt, CASE WHEN k % 5 <> 0 THEN CAST(date AS STRING) || 'T07:00:00' END AS timestamp_local,
          100 + k % 50 AS systolic, NULL AS diastolic, 'NORMAL' AS category_name
        FROM (SELECT profile_id, date, max(k) AS k FROM {_ORDERS} GROUP BY 1, 2), LATERAL (SELECT unnest(CASE k % 3 WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [1] ELSE [] END) AS copy)""",
)
def flatten_blood_pressure(f: Frames) -> DataFrame:
    return P.flatten_bp(landed(f, P.PRESSURE, BP))


@query(
    "flatten_nutrition",
    "profile_id, date:d, consumed_calories:i, protein_g:2",
    f"SELECT profile_id, date, k % 3 * 900 AS consumed_calories, 80.25e0 AS protein_g FROM (SELECT profile_id, date, max(k) AS k FROM {_ORDERS} GROUP BY 1, 2) WHERE k % 3 > 0 AND k % 7 > 0",
)
def flatten_nutrition(f: Frames) -> DataFrame:
    body = f"named_struct('calories', {K_} % 3 * 900, 'protein', 80.25e0)"
    return P.flatten_nutrition(landed(f, P.NUTRITION, f"if({K_} % 7 = 0, '{{\"dailyNutritionContent\":[]}}', to_json(named_struct('dailyNutritionContent', {body})))"))


ACTIVITY = f"""to_json(named_struct('activityId', {K_}, 'activityName', concat('Run ', {K_}), 'activityType', named_struct('typeKey', lower(o_orderpriority)),
  'startTimeLocal', if({K_} % 13 = 0, 'yesterday', concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 06:30:00')), 'distance', o_totalprice, 'averageHR', {K_} % 100 + 0.5e0, 'calories', {K_} % 700,
  'averageBikingCadenceInRevsPerMinute', 80e0, 'averageRunningCadenceInStepsPerMinute', if({K_} % 2 = 0, 170e0, null), 'eventType', named_struct('typeKey', 'race')))"""


@query(
    "flatten_activities",
    "activity_id:i, profile_id, activity_name, activity_type, start_local, distance_m:2, avg_hr:i, calories:i, avg_cadence:2, max_hr:i, is_race",
    """SELECT o_orderkey AS activity_id, c_nationkey AS profile_id, 'Run ' || CAST(o_orderkey AS STRING) AS activity_name, lower(o_orderpriority) AS activity_type,
         CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 06:30:00' END AS start_local, o_totalprice AS distance_m, o_orderkey % 100 + 1 AS avg_hr, o_orderkey % 700 AS calories,
         CASE WHEN o_orderkey % 2 = 0 THEN 170 ELSE 80 END AS avg_cadence, NULL AS max_hr, true AS is_race FROM customer_orders WHERE o_orderkey % 13 <> 0""",
)
def flatten_activities(f: Frames) -> DataFrame:
    flat = P.flatten_activities(landed(f, P.ACTIVITY, ACTIVITY))
    return flat.withColumns(
        {
            "start_local": F.col("start_time_local").cast("string"),
            "is_race": F.get_json_object("raw_json", "$.eventType.typeKey") == "race",
        }
    )


@query(
    "rejected_activities",
    "profile_id, rejected:i, landed:i",
    "SELECT c_nationkey AS profile_id, count(*) FILTER (o_orderkey % 13 = 0) AS rejected, count(*) AS landed FROM customer_orders GROUP BY 1",
)
def rejected_activities(f: Frames) -> DataFrame:
    return P.rejected_activities(landed(f, P.ACTIVITY, ACTIVITY))


@query(
    "array_metric_pivot",
    "activity_id:i, row_pos:i, timestamp_ms:i, elapsed_sec:6, heart_rate:i, cadence:i, speed:6, power:i, lat:6",
    """SELECT vec_id AS activity_id, p AS row_pos, CAST(trunc(m[1] * 1000) AS BIGINT) AS timestamp_ms, m[2] AS elapsed_sec, CAST(round(m[3] * 1) AS INT) AS heart_rate, CAST(round(coalesce(m[61], m[5])) AS INT) AS cadence, m[6] AS speed,
         NULL AS power, m[64] AS lat
       FROM (SELECT vec_id, p, CASE p WHEN 0 THEN v WHEN 1 THEN [label * 1e0, label * 2e0, label * 3e0] ELSE [] END AS m
             FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 100) AS v, unnest([0, 1, 2]) AS p FROM embeddings))""",
)
def array_metric_pivot(f: Frames) -> DataFrame:
    values = "transform(embedding, (x, i) -> CAST(x AS DOUBLE) * if(i = 0, 100000e0, 100e0))"
    descriptors = """array(named_struct('key', 'directTimestamp', 'metricsIndex', 0), named_struct('key', 'sumElapsedDuration', 'metricsIndex', 1), named_struct('key', 'directHeartRate', 'metricsIndex', 7),
      named_struct('key', 'directHeartRate', 'metricsIndex', 2), named_struct('key', 'directRunCadence', 'metricsIndex', 60), named_struct('key', 'bikeCadence', 'metricsIndex', 4), named_struct('key', 'directSpeed', 'metricsIndex', 5),
      named_struct('key', 'directPower', 'metricsIndex', null), named_struct('key', 'directLatitude', 'metricsIndex', 63))"""
    short = "array(label * 1000e0, label * 2e0, label * 3e0)"
    rows = f"array(named_struct('metrics', {values}), named_struct('metrics', {short}), named_struct('metrics', cast(array() AS array<double>)))"
    raw = f.table("embeddings").selectExpr(
        "vec_id AS activity_id",
        f"'{P.DETAILS}' AS endpoint",
        f"to_json(named_struct('metricDescriptors', {descriptors}, 'activityDetailMetrics', {rows})) AS payload",
        "vec_id AS ingest_seq",
    )
    return P.flatten_details(raw)


LAP = f"named_struct('lapIndex', if({K_} % 2 = 0, null, 10 + {K_} % 3), 'intensityType', if({K_} % 5 = 0, null, 'INTERVAL'), 'splitType', 'REST', 'distance', o_totalprice, 'averageHR', 120.5e0)"


@query(
    "nested_explode",
    "activity_id:i, split_number:i, split_type, distance_m:2, avg_hr:i",
    """SELECT k AS activity_id, CASE WHEN k % 2 = 0 THEN p ELSE 10 + k % 3 END AS split_number, CASE WHEN k % 5 = 0 THEN 'REST' ELSE 'INTERVAL' END AS split_type, price AS distance_m, 121 AS avg_hr
       FROM (SELECT o_orderkey AS k, o_totalprice AS price, unnest(CASE o_orderkey % 3 WHEN 0 THEN [1, 2] WHEN 1 THEN [1] ELSE [] END) AS p FROM orders)""",
)
def nested_explode(f: Frames) -> DataFrame:
    payload = f"CASE {K_} % 3 WHEN 0 THEN to_json(named_struct('lapDTOs', array({LAP}, {LAP}), 'splitDTOs', array({LAP}))) WHEN 1 THEN to_json(named_struct('splitDTOs', array({LAP}))) ELSE '{{}}' END"
    return P.flatten_splits(landed(f, P.SPLITS, payload))


@query(
    "map_lookup",
    "event_id:i, phrase",
    """SELECT event_id, CASE CAST(props ->> '$.k' AS INT) % 3 WHEN 0 THEN event_type WHEN 1 THEN 'from history' END AS phrase FROM events""",
)
def map_lookup(f: Frames) -> DataFrame:
    k = "CAST(get_json_object(props, '$.k') AS INT) % 3"
    day = "date_format(ts, 'yyyy-MM-dd')"
    doc = F.expr(
        f"""named_struct('mostRecentTrainingStatus', named_struct('latestTrainingStatusData', map('a', named_struct('calendarDate', '1999-01-01', 'trainingStatusFeedbackPhrase', 'WRONG'),
          'b', named_struct('calendarDate', if({k} = 0, {day}, '1999-01-02'), 'trainingStatusFeedbackPhrase', event_type))),
          'trainingStatusHistory', array(named_struct('calendarDate', if({k} = 1, {day}, '1999-01-03'), 'trainingStatusFeedbackPhrase', 'from history')))"""
    )
    return f.events.select("event_id", P.training_status(doc, F.col("date")).alias("phrase"))


@query(
    "json_coercions",
    "event_id:i, cut:i, strict_float:i, strict_int:i, rounded:i, text_is_null",
    """SELECT event_id, CAST(trunc(value) AS INT) AS cut, CASE WHEN value = trunc(value) THEN NULL END AS strict_float, CAST(props ->> '$.k' AS INT) AS strict_int, CAST(round(value) AS INT) AS rounded, true AS text_is_null FROM events""",
)
def json_coercions(f: Frames) -> DataFrame:
    doc = F.parse_json(F.to_json(F.struct(F.col("value").alias("a"), F.get_json_object("props", "$.k").cast("int").alias("b"), F.lit("word").alias("c"))))
    return f.table("events").select(
        "event_id",
        P.json_int(doc, "$.a").alias("cut"),
        P.json_int(doc, "$.a", "strict").alias("strict_float"),
        P.json_int(doc, "$.b", "strict").alias("strict_int"),
        P.json_int(doc, "$.a", "round").alias("rounded"),
        P.json_int(doc, "$.c").isNull().alias("text_is_null"),
    )


@query(
    "payload_shape",
    "endpoint, path, kind, n:i, least_size:i, most_size:i",
    """SELECT 'event' AS endpoint, path, kind, count(*) AS n, min(size) AS least_size, max(size) AS most_size FROM (
         SELECT unnest(['k', 'list', 'none', 'inner', 'name', 'flag']) AS path, unnest(['num', 'array', 'null', 'object', 'str', 'bool']) AS kind, unnest([NULL, 1 + event_id % 2, NULL, 1, NULL, NULL]) AS size FROM events
         UNION ALL SELECT '[0].value', 'num', NULL FROM events) GROUP BY 2, 3""",
)
def payload_shape(f: Frames) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    whole = F.concat(F.lit('{"k":'), k, F.when(F.col("event_id") % 2 == 0, F.lit(',"list":[1]')).otherwise(F.lit(',"list":[1,2]')), F.lit(',"none":null,"inner":{"x":1},"flag":true,"name":"'), F.col("event_type"), F.lit('"}'))
    listed = F.concat(F.lit('[{"value":'), k, F.lit("}]"))
    ev = f.table("events")
    raw = ev.select(F.lit("event").alias("endpoint"), whole.alias("payload")).unionByName(
        ev.select(F.lit("event").alias("endpoint"), listed.alias("payload"))
    )
    return P.payload_shape(raw)


# ------------------------------------------------------ schema evolution, sinks
@query(
    "schema_union",
    "l_orderkey:i, l_linenumber:i, l_partkey:i, l_extendedprice:2, l_quantity:2, l_tax:3, l_shipmode",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, floor(l_quantity) AS l_quantity, NULL AS l_tax, NULL AS l_shipmode FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'
       UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_tax, 'x' || l_returnflag FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'""",
)
def schema_union(f: Frames) -> DataFrame:
    """Two generations of a table: a column changes from INT to DOUBLE, two are new."""
    path = scratch_path(f.spark, "generations")
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    lines = f.table("lineitem")
    old = lines.where("l_shipdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'").select(*keep, F.floor("l_quantity").cast("int").alias("l_quantity"))
    new = lines.where("l_shipdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'").select(
        *keep, "l_quantity", "l_tax", F.concat(F.lit("x"), "l_returnflag").alias("l_shipmode")
    )
    old.write.parquet(f"{path}/lines/gen=1")
    new.write.parquet(f"{path}/lines/gen=2")
    return E.scan_entity(f.spark, path, "lines")


@query(
    "upsert_merge",
    "user_id:i, date:d, n:i, total:2, note",
    """SELECT user_id, date, CASE WHEN late THEN -n ELSE n END AS n, total, CASE WHEN late THEN 'rewritten' END AS note
       FROM (SELECT user_id, date, count(*) AS n, sum(value) AS total, date >= DATE '2024-01-20' AS late FROM ev GROUP BY 1, 2)""",
)
def upsert_merge(f: Frames) -> DataFrame:
    per_day = f.events.groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    old = per_day.withColumn("dropped_later", F.lit(1)).where("date < DATE '2024-01-25'")
    new = per_day.where("date >= DATE '2024-01-20'").withColumns({"n": -F.col("n"), "note": F.lit("rewritten")})
    return K.merge_rows(old, new, ["user_id", "date"])


@query(
    "upsert_table",
    "user_id:i, date:d, n:i, total:2",
    """SELECT user_id, date, CASE WHEN date >= DATE '2024-01-20' THEN -n ELSE n END AS n, total FROM (SELECT user_id, date, count(*) AS n, sum(value) AS total FROM ev GROUP BY 1, 2)""",
)
def upsert_table(f: Frames) -> DataFrame:
    """The same merge through a stored, partitioned table: two writes, the second overlapping the first."""
    path = scratch_path(f.spark, "upsert")
    per_day = f.events.groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    # some users' rows have no partition value
    per_day = per_day.withColumn("week", F.when(F.col("user_id") % 5 > 0, F.weekofyear("date")))
    K.upsert(f.spark, path, per_day.where("date < DATE '2024-01-25'"), ["user_id", "date"], ["week"])
    K.upsert(f.spark, path, per_day.where("date >= DATE '2024-01-20'").withColumn("n", -F.col("n")), ["user_id", "date"], ["week"])
    return E.read_table(f.spark, path)


@query(
    "upsert_splits",
    "activity_id:i, split_number:i, distance_m:2",
    "SELECT l_orderkey AS activity_id, l_linenumber AS split_number, sum(CASE WHEN l_linenumber >= 3 THEN -l_extendedprice ELSE l_extendedprice END) AS distance_m FROM lineitem GROUP BY 1, 2",
)
def upsert_splits(f: Frames) -> DataFrame:
    """Splits landed with their own keys and hashed folders, the later ones twice."""
    path = scratch_path(f.spark, "splits")
    lines = f.table("lineitem")
    splits = lines.groupBy(F.col("l_orderkey").alias("activity_id"), F.col("l_linenumber").alias("split_number")).agg(F.sum("l_extendedprice").alias("distance_m"))
    K.upsert_entity(f.spark, path, "activity_splits", splits)
    K.upsert_entity(f.spark, path, "activity_splits", splits.where("split_number >= 3").withColumn("distance_m", -F.col("distance_m")))
    return E.load_activity_splits(f.spark, path)


@query(
    "landed_day_tables",
    "profile_id, date:d, steps:i, resting_hr:i, vo2max:2",
    f"""SELECT profile_id, date, k * 2 AS steps, k % 100 AS resting_hr, CASE WHEN k % 3 > 0 THEN CASE WHEN k % 2 = 0 THEN 40.5e0 ELSE 41.5e0 END END AS vo2max
        FROM (SELECT profile_id, date, max(k) AS k FROM {_ORDERS} GROUP BY 1, 2)""",
)
def landed_day_tables(f: Frames) -> DataFrame:
    """From landed payloads to stored tables and back: flatten, upsert with the entity's keys, load by date."""
    path = scratch_path(f.spark, "day-tables")
    K.upsert_entity(f.spark, path, "daily_health", P.flatten_daily_health(landed(f, P.SUMMARY, SUMMARY)))
    K.upsert_entity(f.spark, path, "performance_metrics", P.flatten_performance(landed(f, P.VO2, _sparse(VO2, f"{K_} % 3 > 0"))))
    health, fitness = E.load_daily_health(f.spark, path), E.load_performance_metrics(f.spark, path)
    return health.select("profile_id", "date", "steps", "resting_hr").join(fitness.select("profile_id", "date", "vo2max"), ["profile_id", "date"])


@query(
    "derived_tables",
    "profile_id, month:d, rows_read:i, has_decomposed",
    "SELECT profile_id, date_trunc('month', date) AS month, count(*) AS rows_read, false AS has_decomposed FROM acts GROUP BY 1, 2",
)
def derived_tables(f: Frames) -> DataFrame:
    """A derived table saved twice (the second replaces the first), its landed months, and an absent one."""
    path = scratch_path(f.spark, "derived")
    acts = f.acts.select("profile_id", "activity_id", "date").withColumn("ym", F.date_format("date", "yyyy-MM"))
    K.save(acts.limit(0), f"{path}/activities", ["ym"])
    K.save(acts, f"{path}/activities", ["ym"])
    months = E.landed_partitions(f.spark, f"{path}/activities")
    absent = E.load_decomposed(f.spark, path) is None
    read = f.spark.read.parquet(f"{path}/activities").withColumn("month", F.trunc("date", "month"))
    return read.join(months.select("month").distinct(), "month").groupBy("profile_id", "month").agg(F.count(F.lit(1)).alias("rows_read"), F.lit(not absent).alias("has_decomposed"))


@query(
    "incremental_keys",
    "user_id:i, date:d",
    """SELECT user_id, date FROM (SELECT DISTINCT user_id, date FROM ev)
       WHERE (user_id, date) NOT IN (SELECT user_id, date FROM ev WHERE event_type = 'click') OR date >= DATE '2024-01-29' AND date <= DATE '2024-01-30'""",
)
def incremental_keys(f: Frames) -> DataFrame:
    done = f.events.where("event_type = 'click'")
    return K.pending_keys(f.events, done, ["user_id", "date"], K.refresh_recent("nutrition", "date", "2024-01-30"))


@query(
    "activity_status",
    "activity_id:i, status",
    "SELECT o_orderkey AS activity_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'loaded' ELSE 'no_data' END AS status FROM orders",
)
def activity_status(f: Frames) -> DataFrame:
    lines = f.table("lineitem").select(F.col("l_orderkey").alias("activity_id"))
    return K.activity_status(f.table("orders").select(F.col("o_orderkey").alias("activity_id")), lines)


@query(
    "existing_keys",
    "profile_id, month",
    "SELECT DISTINCT profile_id, strftime(date, '%Y-%m') AS month FROM acts",
)
def existing_keys(f: Frames) -> DataFrame:
    return E.existing_keys(f.acts, ["profile_id", F.date_format("date", "yyyy-MM").alias("month")])


@query(
    "details_for",
    "activity_id:i, n:i",
    "SELECT activity_id, count(*) AS n FROM splits WHERE activity_id IN (SELECT activity_id FROM run_like WHERE date >= DATE '2001-01-01') GROUP BY 1",
)
def details_for(f: Frames) -> DataFrame:
    chosen = f.acts.where(F.col("activity_type").isin("running", "treadmill_running")).where("date >= DATE '2001-01-01'")
    return E.details_for(f.splits, chosen).groupBy("activity_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stored_details",
    "activity_id:i, n:i, speed:4, last_pos:i",
    "SELECT activity_id, count(*) AS n, sum(speed) AS speed, max(row_pos) AS last_pos FROM samples WHERE activity_id IN (SELECT activity_id FROM runs WHERE profile_id = 3 AND date >= DATE '2000-01-01') GROUP BY 1",
)
def stored_details(f: Frames) -> DataFrame:
    """Per-second samples landed in hashed folders, and those of some activities read back from their folders only."""
    path = scratch_path(f.spark, "details")
    K.upsert_entity(f.spark, path, "activity_details", f.samples)
    chosen = f.runs.where("profile_id = 3 AND date >= DATE '2000-01-01'")
    found = E.details_for(E.load_activity_details(f.spark, path), chosen)
    return found.groupBy("activity_id").agg(F.count(F.lit(1)).alias("n"), F.sum("speed").alias("speed"), F.max("row_pos").alias("last_pos"))


_SPAN = {"frm": "2000-02-01", "to": "2000-08-15"}


@query(
    "stored_entities",
    "entity, n:i, days:i, total:2",
    f"""SELECT 'activities' AS entity, count(*) AS n, count(DISTINCT date) AS days, sum(training_load) AS total FROM acts
        UNION ALL SELECT 'activity_splits', count(*), count(DISTINCT activity_id), sum(split_number) FROM (SELECT DISTINCT activity_id, split_number FROM splits)
        UNION ALL SELECT 'weight', count(*), count(DISTINCT date), sum(weight_kg) FROM weight WHERE date BETWEEN DATE '2000-02-01' AND DATE '2000-08-15'
        UNION ALL SELECT 'blood_pressure', count(*), count(DISTINCT date), sum(systolic) FROM pressure WHERE date BETWEEN DATE '2000-02-01' AND DATE '2000-08-15'
        UNION ALL SELECT 'nutrition', count(*), count(DISTINCT date), sum(k % 3 * 900) FROM (SELECT profile_id, date, max(k) AS k FROM {_ORDERS} GROUP BY 1, 2)
          WHERE k % 3 > 0 AND k % 7 > 0 AND date BETWEEN DATE '2000-02-01' AND DATE '2000-08-15'""",
)
def stored_entities(f: Frames) -> DataFrame:
    """Each entity landed with its own keys and folders, twice, and read back by its loader (some between two dates)."""
    path = scratch_path(f.spark, "entities")
    tables = {
        "activities": f.acts,
        "activity_splits": f.splits.dropDuplicates(["activity_id", "split_number"]),
        "weight": f.weight,
        "blood_pressure": f.pressure,
        "nutrition": flatten_nutrition(f),
    }
    for entity, rows in tables.items():
        K.upsert_entity(f.spark, path, entity, rows)
    K.upsert_entity(f.spark, path, "weight", f.weight.where("date > DATE '2000-05-01'"))
    loaded = {
        "activities": (E.load_activities(f.spark, path), "date", "training_load"),
        "activity_splits": (E.load_activity_splits(f.spark, path), "activity_id", "split_number"),
        "weight": (E.load_weight(f.spark, path, **_SPAN), "date", "weight_kg"),
        "blood_pressure": (E.load_blood_pressure(f.spark, path, **_SPAN), "date", "systolic"),
        "nutrition": (E.load_nutrition(f.spark, path, **_SPAN), "date", "consumed_calories"),
    }
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(day).alias("days"), F.sum(F.col(value).cast("double")).alias("total")).select(F.lit(entity).alias("entity"), "*")
        for entity, (df, day, value) in loaded.items()
    ]
    return K.union_all(parts)


# ------------------------------------------------------------------- streaming
@query(
    "stream_daily_rollup",
    "user_id:i, date:d, n:i, total:2, peak:2",
    "SELECT user_id, date, count(*) AS n, sum(value) AS total, max(value) AS peak FROM ev GROUP BY 1, 2",
)
def stream_daily_rollup(f: Frames) -> DataFrame:
    """The events as a file stream, rolled up per day and upserted into a table until all is read."""
    path = scratch_path(f.spark, "stream")
    schema = f.table("events").schema
    stream = U.landing_stream(f.spark, f.base, schema, files="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rollup = U.daily_rollup_stream(stream, ["user_id"], "ts", "value", "60 days").withColumn("week", F.weekofyear("date"))
    U.stream_upsert(rollup, f"{path}/table", ["user_id", "date"], ["week"], f"{path}/checkpoint", mode="update").awaitTermination()
    return E.read_table(f.spark, f"{path}/table")
