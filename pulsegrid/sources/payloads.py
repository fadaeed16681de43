"""Flattening landed JSON payloads into the entity tables.

Input: ``profile_id, endpoint, key_date, activity_id, payload, ingest_seq``. Each
payload is parsed once with an explicit schema, which is also the type check: a
LONG field takes whole numbers only, a DOUBLE field any number, anything else
reads as null. Several payloads of the same key keep the last landed one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_ms_text
from ..operators.windows import keep_last

# Endpoint names of the landing table.
SUMMARY, SLEEP, HRV = "daily_summary", "sleep", "hrv"
VO2, FITNESS_AGE, RACE, READINESS = "vo2max", "fitness_age", "race_predictions", "training_readiness"
STATUS, ENDURANCE, HILL = "training_status", "endurance_score", "hill_score"
WEIGHT, PRESSURE, NUTRITION = "weight", "blood_pressure", "nutrition"
ACTIVITY, DETAILS, SPLITS = "activity", "activity_details", "activity_splits"


# ------------------------------------------------------------- coercion rules
def int_trunc(c: Column) -> Column:
    """Any number, fraction cut off."""
    return c.try_cast("int")


def int_strict(c: Column) -> Column:
    """Whole numbers only (the field is declared BIGINT)."""
    return c.try_cast("int")


def int_round(c: Column) -> Column:
    """Any number, halves away from zero."""
    return F.round(c).try_cast("int")


def json_int(v: Column, path: str, mode: str = "trunc") -> Column:
    """Integer at a path of a variant: ``trunc``, ``strict`` (integers only) or ``round``."""
    if mode == "strict":
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        return F.when(kind == "BIGINT", F.try_variant_get(v, path, "int"))
    number = F.try_variant_get(v, path, "double")
    return int_round(number) if mode == "round" else int_trunc(number)


def parse_ts(c: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` as a zone-less timestamp; anything else is null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), c.try_cast("timestamp_ntz"))


def parse_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c.try_cast("date"))


# ------------------------------------------------------------------- plumbing
def _latest(raw: DataFrame, endpoint: str, keys: Sequence[str]) -> DataFrame:
    return keep_last(raw.where(F.col("endpoint") == endpoint), keys, ["ingest_seq"])


def _daily_parsed(raw: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """One row per (profile, date) with the parsed payload of each endpoint as a struct.

    The endpoints are brought side by side by one aggregation instead of a chain
    of joins; ``max_by`` on the landing sequence keeps the last payload of each.
    """
    keys = ["profile_id", "key_date"]
    mine = raw.where(F.col("endpoint").isin(list(schemas)))
    latest = [
        F.max_by("payload", F.when(F.col("endpoint") == e, F.col("ingest_seq"))).alias(f"p_{e}") for e in schemas
    ]
    wide = mine.groupBy(*keys).agg(*latest)
    return wide.select(*keys, *[F.from_json(f"p_{e}", s).alias(e) for e, s in schemas.items()])


# --------------------------------------------------------------- daily health
SUMMARY_SCHEMA = (
    "totalSteps DOUBLE, dailyStepGoal DOUBLE, totalKilocalories DOUBLE, activeKilocalories DOUBLE, "
    "bmrKilocalories DOUBLE, restingHeartRate DOUBLE, sleepingSeconds DOUBLE, averageStressLevel DOUBLE, "
    "maxStressLevel DOUBLE, bodyBatteryAtWakeTime DOUBLE, bodyBatteryMostRecentValue DOUBLE, "
    "avgWakingRespirationValue DOUBLE, averageSpo2 DOUBLE, lowestSpo2 DOUBLE, moderateIntensityMinutes DOUBLE, "
    "vigorousIntensityMinutes DOUBLE, consumedKilocalories DOUBLE"
)
_SLEEP_FIELDS = (
    "sleepTimeSeconds: DOUBLE, deepSleepSeconds: DOUBLE, lightSleepSeconds: DOUBLE, remSleepSeconds: DOUBLE, "
    "sleepScores: STRUCT<overall: STRUCT<value: BIGINT>>"
)
SLEEP_SCHEMA = f"STRUCT<dailySleepDTO: STRUCT<{_SLEEP_FIELDS}>, {_SLEEP_FIELDS}>"
HRV_SCHEMA = "hrvSummary STRUCT<weeklyAvg: DOUBLE, lastNight: DOUBLE, lastNightAvg: DOUBLE, status: STRING>"


def sleep_cols(sleep: Column) -> dict[str, Column]:
    """Sleep durations and score, with or without the wrapper object."""
    wrapped = sleep["dailySleepDTO"].isNotNull()

    def pick(name: str) -> Column:
        return F.when(wrapped, sleep["dailySleepDTO"][name]).otherwise(sleep[name])

    deep, light, rem = (int_trunc(pick(n)) for n in ("deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds"))
    scores = F.when(wrapped, sleep["dailySleepDTO"]["sleepScores"]["overall"]["value"]).otherwise(
        sleep["sleepScores"]["overall"]["value"]
    )
    return {
        "total": F.coalesce(int_trunc(pick("sleepTimeSeconds")), deep + light + rem),
        "deep_sleep_seconds": deep,
        "light_sleep_seconds": light,
        "rem_sleep_seconds": rem,
        "sleep_score": int_strict(scores),
    }


def hrv_cols(hrv: Column) -> dict[str, Column]:
    s = hrv["hrvSummary"]
    return {
        "hrv_weekly_avg": int_trunc(s["weeklyAvg"]),
        "hrv_last_night": F.coalesce(int_trunc(s["lastNight"]), int_trunc(s["lastNightAvg"])),
        "hrv_status": s["status"],
    }


def flatten_daily_health(raw: DataFrame) -> DataFrame:
    """Summary, sleep and HRV payloads of a day as one daily_health row."""
    parsed = _daily_parsed(raw, {SUMMARY: SUMMARY_SCHEMA, SLEEP: SLEEP_SCHEMA, HRV: HRV_SCHEMA})
    h, sleep, hrv = F.col(SUMMARY), sleep_cols(F.col(SLEEP)), hrv_cols(F.col(HRV))

    def whole(name: str) -> Column:
        return int_trunc(h[name])

    def level(name: str) -> Column:
        v = whole(name)
        return F.when(v >= 0, v)

    cols = {
        "steps": whole("totalSteps"),
        "step_goal": whole("dailyStepGoal"),
        "total_calories": whole("totalKilocalories"),
        "active_calories": whole("activeKilocalories"),
        "bmr_calories": whole("bmrKilocalories"),
        "resting_hr": whole("restingHeartRate"),
        "sleep_seconds": F.coalesce(sleep["total"], whole("sleepingSeconds")),
        "deep_sleep_seconds": sleep["deep_sleep_seconds"],
        "light_sleep_seconds": sleep["light_sleep_seconds"],
        "rem_sleep_seconds": sleep["rem_sleep_seconds"],
        "sleep_score": sleep["sleep_score"],
        "avg_stress": level("averageStressLevel"),
        "max_stress": level("maxStressLevel"),
        "body_battery_start": whole("bodyBatteryAtWakeTime"),
        "body_battery_end": whole("bodyBatteryMostRecentValue"),
        **hrv,
        "avg_respiration": h["avgWakingRespirationValue"],
        "avg_spo2": whole("averageSpo2"),
        "lowest_spo2": whole("lowestSpo2"),
        "hydration_ml": F.lit(None).cast("int"),
        "moderate_intensity_min": whole("moderateIntensityMinutes"),
        "vigorous_intensity_min": whole("vigorousIntensityMinutes"),
        "consumed_calories": whole("consumedKilocalories"),
    }
    return parsed.select("profile_id", F.col("key_date").alias("date"), *[c.alias(n) for n, c in cols.items()])


# ---------------------------------------------------------------- performance
# An array schema also reads a single object, as a one-element array.
PERFORMANCE_SCHEMAS = {
    VO2: "ARRAY<STRUCT<generic: STRUCT<vo2MaxValue: DOUBLE, fitnessAge: BIGINT>>>",
    FITNESS_AGE: "STRUCT<fitnessAge: DOUBLE>",
    RACE: "ARRAY<STRUCT<time5K: BIGINT, time10K: BIGINT, timeHalfMarathon: BIGINT, timeMarathon: BIGINT>>",
    READINESS: "ARRAY<STRUCT<score: BIGINT>>",
    STATUS: (
        "STRUCT<mostRecentTrainingStatus: STRUCT<latestTrainingStatusData: "
        "MAP<STRING, STRUCT<calendarDate: STRING, trainingStatusFeedbackPhrase: STRING>>>, "
        "trainingStatusHistory: ARRAY<STRUCT<calendarDate: STRING, trainingStatusFeedbackPhrase: STRING>>>"
    ),
    ENDURANCE: "ARRAY<STRUCT<overallScore: BIGINT>>",
    HILL: "ARRAY<STRUCT<overallScore: BIGINT>>",
}


def training_status(doc: Column, day: Column) -> Column:
    """Status phrase dated exactly ``day``: from any device, else from the history."""
    text = F.date_format(day, "yyyy-MM-dd")

    def first_match(entries: Column, need_phrase: bool) -> Column:
        def same(e: Column) -> Column:
            hit = e["calendarDate"] == text
            return hit & e["trainingStatusFeedbackPhrase"].isNotNull() if need_phrase else hit

        return F.get(F.filter(entries, same), 0)["trainingStatusFeedbackPhrase"]

    devices = F.map_values(doc["mostRecentTrainingStatus"]["latestTrainingStatusData"])
    return F.coalesce(first_match(devices, False), first_match(doc["trainingStatusHistory"], True))


def flatten_performance(raw: DataFrame) -> DataFrame:
    """Seven performance payloads of a day as one performance_metrics row."""
    parsed = _daily_parsed(raw, PERFORMANCE_SCHEMAS)
    vo2, race = F.get(VO2, 0)["generic"], F.get(RACE, 0)
    return parsed.select(
        "profile_id",
        F.col("key_date").alias("date"),
        vo2["vo2MaxValue"].alias("vo2max"),
        F.coalesce(int_round(F.col(FITNESS_AGE)["fitnessAge"]), int_strict(vo2["fitnessAge"])).alias("fitness_age"),
        int_strict(F.get(READINESS, 0)["score"]).alias("training_readiness"),
        training_status(F.col(STATUS), F.col("key_date")).alias("training_status"),
        int_strict(race["time5K"]).alias("race_5k_sec"),
        int_strict(race["time10K"]).alias("race_10k_sec"),
        int_strict(race["timeHalfMarathon"]).alias("race_half_sec"),
        int_strict(race["timeMarathon"]).alias("race_marathon_sec"),
        int_strict(F.get(ENDURANCE, 0)["overallScore"]).alias("endurance_score"),
        int_strict(F.get(HILL, 0)["overallScore"]).alias("hill_score"),
    )


# ------------------------------------------------------- weight, BP, nutrition
_WEIGHT_METRIC = (
    "calendarDate: STRING, date: BIGINT, timestampGMT: STRING, samplePk: BIGINT, weight: DOUBLE, bmi: DOUBLE, "
    "bodyFat: DOUBLE, bodyWater: DOUBLE, boneMass: DOUBLE, muscleMass: DOUBLE, physiqueRating: BIGINT, "
    "visceralFat: DOUBLE, metabolicAge: BIGINT, sourceType: STRING"
)
WEIGHT_SCHEMA = (
    "dailyWeightSummaries ARRAY<STRUCT<summaryDate: STRING, "
    f"allWeightMetrics: ARRAY<STRUCT<{_WEIGHT_METRIC}>>, latestWeight: STRUCT<{_WEIGHT_METRIC}>>>"
)


def flatten_weight(raw: DataFrame) -> DataFrame:
    """One row per weigh-in; a missing list falls back to the latest one, an empty list gives none."""
    doc = _latest(raw, WEIGHT, ["profile_id", "key_date"]).select("profile_id", F.from_json("payload", WEIGHT_SCHEMA).alias("doc"))
    days = doc.select("profile_id", F.explode("doc.dailyWeightSummaries").alias("s"))
    latest = F.when(F.col("s.latestWeight").isNotNull(), F.array("s.latestWeight"))
    m = days.select("profile_id", F.col("s.summaryDate").alias("_day"), F.inline(F.coalesce("s.allWeightMetrics", latest)))
    return m.select(
        "profile_id",
        parse_date(F.coalesce("calendarDate", "_day")).alias("date"),
        F.coalesce(epoch_ms_text("date"), F.col("timestampGMT")).alias("timestamp_gmt"),
        F.col("samplePk").alias("sample_pk"),
        (F.col("weight") / 1000.0).alias("weight_kg"),
        F.col("weight").alias("weight_grams"),
        "bmi",
        F.col("bodyFat").alias("body_fat"),
        F.col("bodyWater").alias("body_water"),
        F.col("boneMass").alias("bone_mass"),
        F.col("muscleMass").alias("muscle_mass"),
        int_strict(F.col("physiqueRating")).alias("physique_rating"),
        F.col("visceralFat").alias("visceral_fat"),
        int_strict(F.col("metabolicAge")).alias("metabolic_age"),
        F.col("sourceType").alias("source_type"),
    )


_BP = (
    "STRUCT<measurementTimestampLocal: STRING, measurementTimestampGMT: STRING, systolic: BIGINT, diastolic: BIGINT, "
    "pulse: BIGINT, category: BIGINT, categoryName: STRING, notes: STRING, sourceType: STRING, version: BIGINT>"
)


def flatten_bp(raw: DataFrame) -> DataFrame:
    """One row per reading, from nested summaries or from a flat array of readings."""
    doc = _latest(raw, PRESSURE, ["profile_id", "key_date"])
    nested = F.from_json("payload", f"measurementSummaries ARRAY<STRUCT<measurements: ARRAY<{_BP}>>>")["measurementSummaries"]
    per_summary = F.transform(nested, lambda s: F.coalesce(s["measurements"], F.array().cast(f"ARRAY<{_BP}>")))
    flat = F.when(F.ltrim("payload").startswith("["), F.from_json("payload", f"ARRAY<{_BP}>"))
    m = doc.select("profile_id", F.inline(F.coalesce(F.flatten(per_summary), flat)))
    local = F.col("measurementTimestampLocal")
    gmt = F.coalesce("measurementTimestampGMT", local)
    return m.select(
        "profile_id",
        parse_date(F.substring_index(F.coalesce(local, gmt), "T", 1)).alias("date"),
        gmt.alias("timestamp_gmt"),
        local.alias("timestamp_local"),
        *[int_strict(F.col(c)).alias(c) for c in ("systolic", "diastolic", "pulse", "category")],
        F.col("categoryName").alias("category_name"),
        "notes",
        F.col("sourceType").alias("source_type"),
        int_strict(F.col("version")).alias("version"),
    )


def flatten_nutrition(raw: DataFrame) -> DataFrame:
    """One row per day with logged food; days without calories are dropped."""
    doc = _latest(raw, NUTRITION, ["profile_id", "key_date"])
    schema = "dailyNutritionContent STRUCT<calories: BIGINT, protein: DOUBLE, carbs: DOUBLE, fat: DOUBLE>"
    n = F.from_json("payload", schema)["dailyNutritionContent"]
    out = doc.select(
        "profile_id",
        F.col("key_date").alias("date"),
        int_strict(n["calories"]).alias("consumed_calories"),
        n["protein"].alias("protein_g"),
        n["carbs"].alias("carbs_g"),
        n["fat"].alias("fat_g"),
    )
    return out.where(F.col("consumed_calories") != 0)


# ------------------------------------------------------------------ activities
ACTIVITY_SCHEMA = (
    "activityId BIGINT, activityName STRING, activityType STRUCT<typeKey: STRING>, startTimeLocal STRING, "
    "startTimeGMT STRING, duration DOUBLE, distance DOUBLE, calories DOUBLE, averageHR DOUBLE, maxHR DOUBLE, "
    "averageSpeed DOUBLE, maxSpeed DOUBLE, elevationGain DOUBLE, elevationLoss DOUBLE, "
    "averageRunningCadenceInStepsPerMinute DOUBLE, averageBikingCadenceInRevsPerMinute DOUBLE, avgPower DOUBLE, "
    "normPower DOUBLE, aerobicTrainingEffect DOUBLE, activityTrainingLoad DOUBLE, startLatitude DOUBLE, "
    "startLongitude DOUBLE, endLatitude DOUBLE, endLongitude DOUBLE, avgGroundContactTime DOUBLE, "
    "avgVerticalOscillation DOUBLE, avgStrideLength DOUBLE, locationName STRING"
)


def flatten_activities(raw: DataFrame) -> DataFrame:
    """The 29-column activities table; the payload itself stays as raw_json.

    Activities without a readable local start time have no place in the calendar and are left out;
    :func:`rejected_activities` counts them.
    """
    doc = _latest(raw, ACTIVITY, ["profile_id", "activity_id"])
    p = doc.select("profile_id", "payload", F.from_json("payload", ACTIVITY_SCHEMA).alias("a")).select("profile_id", "payload", "a.*")
    return p.select(
        F.col("activityId").alias("activity_id"),
        "profile_id",
        F.col("activityName").alias("activity_name"),
        F.col("activityType.typeKey").alias("activity_type"),
        parse_ts(F.col("startTimeLocal")).alias("start_time_local"),
        parse_ts(F.col("startTimeGMT")).alias("start_time_gmt"),
        F.col("duration").alias("duration_sec"),
        F.col("distance").alias("distance_m"),
        int_round(F.col("calories")).alias("calories"),
        int_round(F.col("averageHR")).alias("avg_hr"),
        int_round(F.col("maxHR")).alias("max_hr"),
        F.col("averageSpeed").alias("avg_speed"),
        F.col("maxSpeed").alias("max_speed"),
        F.col("elevationGain").alias("elevation_gain"),
        F.col("elevationLoss").alias("elevation_loss"),
        F.coalesce("averageRunningCadenceInStepsPerMinute", "averageBikingCadenceInRevsPerMinute").alias("avg_cadence"),
        int_round(F.col("avgPower")).alias("avg_power"),
        int_round(F.col("normPower")).alias("normalized_power"),
        F.col("aerobicTrainingEffect").alias("training_effect"),
        F.col("activityTrainingLoad").alias("training_load"),
        F.col("startLatitude").alias("start_lat"),
        F.col("startLongitude").alias("start_lon"),
        F.col("endLatitude").alias("end_lat"),
        F.col("endLongitude").alias("end_lon"),
        F.col("avgGroundContactTime").alias("ground_contact_time"),
        F.col("avgVerticalOscillation").alias("vertical_oscillation"),
        F.col("avgStrideLength").alias("stride_length"),
        F.col("locationName").alias("location_name"),
        F.col("payload").alias("raw_json"),
    ).where(F.col("start_time_local").isNotNull())


def rejected_activities(raw: DataFrame) -> DataFrame:
    """Per profile, how many landed activities have no readable local start time."""
    doc = _latest(raw, ACTIVITY, ["profile_id", "activity_id"])
    start = parse_ts(F.from_json("payload", ACTIVITY_SCHEMA)["startTimeLocal"])
    return doc.groupBy("profile_id").agg(F.count_if(start.isNull()).alias("rejected"), F.count(F.lit(1)).alias("landed"))


DETAILS_SCHEMA = (
    "metricDescriptors ARRAY<STRUCT<key: STRING, metricsIndex: BIGINT>>, "
    "activityDetailMetrics ARRAY<STRUCT<metrics: ARRAY<DOUBLE>>>"
)
# column, source keys in order of preference, coercion
DETAIL_METRICS = [
    ("timestamp_ms", ["directTimestamp"], "long"),
    ("elapsed_sec", ["sumElapsedDuration"], None),
    ("heart_rate", ["directHeartRate"], "round"),
    ("cadence", ["directRunCadence", "bikeCadence", "directDoubleCadence"], "round"),
    ("speed", ["directSpeed"], None),
    ("altitude", ["directElevation"], None),
    ("distance", ["sumDistance"], None),
    ("power", ["directPower"], "round"),
    ("temperature", ["directAirTemperature"], None),
    ("ground_contact_time", ["directGroundContactTime"], None),
    ("vertical_oscillation", ["directVerticalOscillation"], None),
    ("stride_length", ["directStrideLength"], None),
    ("ground_contact_balance", ["directGroundContactBalanceLeft"], None),
    ("respiration_rate", ["directRespirationRate"], None),
    ("lat", ["directLatitude"], None),
    ("lon", ["directLongitude"], None),
]


def metric_index(descriptors: Column, key: str) -> Column:
    """Position of a metric in the samples; the last descriptor wins, malformed ones are skipped."""
    hits = F.filter(descriptors, lambda d: (d["key"] == key) & (d["metricsIndex"] >= 0))
    return F.try_element_at(hits, F.lit(-1))["metricsIndex"].cast("int")


def flatten_details(raw: DataFrame) -> DataFrame:
    """One row per sample, its position kept as ``row_pos``; absent metrics are null."""
    doc = _latest(raw, DETAILS, ["activity_id"]).select("activity_id", F.from_json("payload", DETAILS_SCHEMA).alias("d"))
    keys = [k for _, sources, _ in DETAIL_METRICS for k in sources]
    index = F.named_struct(*[c for k in keys for c in (F.lit(k), metric_index(F.col("d.metricDescriptors"), k))])
    rows = doc.select("activity_id", index.alias("_ix"), F.posexplode("d.activityDetailMetrics").alias("row_pos", "_m"))
    coerce = {None: lambda c: c, "round": int_round, "long": lambda c: c.try_cast("bigint")}
    cols = []
    for name, sources, rule in DETAIL_METRICS:
        value = F.coalesce(*[F.get(F.col("_m.metrics"), F.col(f"_ix.{k}")) for k in sources])
        cols.append(coerce[rule](value).alias(name))
    return rows.select("activity_id", F.col("row_pos").cast("bigint").alias("row_pos"), *cols)


_SPLIT = (
    "ARRAY<STRUCT<lapIndex: BIGINT, intensityType: STRING, splitType: STRING, distance: DOUBLE, duration: DOUBLE, "
    "averageSpeed: DOUBLE, averageHR: DOUBLE, maxHR: DOUBLE, averageRunCadence: DOUBLE, averagePower: DOUBLE, "
    "elevationGain: DOUBLE, elevationLoss: DOUBLE, startLatitude: DOUBLE, startLongitude: DOUBLE, "
    "groundContactTime: DOUBLE, verticalOscillation: DOUBLE, strideLength: DOUBLE>>"
)


def flatten_splits(raw: DataFrame) -> DataFrame:
    """One row per lap (or split); a missing lap index is its 1-based position."""
    doc = _latest(raw, SPLITS, ["activity_id"]).select("activity_id", F.from_json("payload", f"lapDTOs {_SPLIT}, splitDTOs {_SPLIT}").alias("d"))
    rows = doc.select("activity_id", F.posexplode(F.coalesce("d.lapDTOs", "d.splitDTOs")).alias("_pos", "s"))
    return rows.select(
        "activity_id",
        F.coalesce(F.col("s.lapIndex"), F.col("_pos") + 1).try_cast("int").alias("split_number"),
        F.coalesce("s.intensityType", "s.splitType").alias("split_type"),
        F.col("s.distance").alias("distance_m"),
        F.col("s.duration").alias("duration_sec"),
        F.col("s.averageSpeed").alias("avg_speed"),
        int_round(F.col("s.averageHR")).alias("avg_hr"),
        int_round(F.col("s.maxHR")).alias("max_hr"),
        F.col("s.averageRunCadence").alias("avg_cadence"),
        F.col("s.averagePower").alias("avg_power"),
        F.col("s.elevationGain").alias("elevation_gain"),
        F.col("s.elevationLoss").alias("elevation_loss"),
        F.col("s.startLatitude").alias("start_lat"),
        F.col("s.startLongitude").alias("start_lon"),
        F.col("s.groundContactTime").alias("avg_ground_contact_time"),
        F.col("s.verticalOscillation").alias("avg_vertical_oscillation"),
        F.col("s.strideLength").alias("avg_stride_length"),
    )


# ------------------------------------------------------------------ inventory
def payload_shape(raw: DataFrame, by: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Key inventory of a payload corpus: how often each top-level key has which kind, and how large its arrays and objects are.

    Arrays are described by their first element's keys under ``[0].``; the sample
    is the smallest 60-character cut of the values, so it is deterministic.
    """
    doc = raw.select(*by, F.try_parse_json("payload").alias("v")).where(F.col("v").isNotNull())
    kind_of = F.schema_of_variant("v")
    top = doc.withColumn("_kind", kind_of)
    is_array = F.col("_kind").startswith("ARRAY")
    rooted = top.select(
        *by,
        F.when(is_array, F.lit("[0].")).otherwise(F.lit("")).alias("_prefix"),
        F.when(is_array, F.try_variant_get("v", "$[0]", "variant")).otherwise(F.col("v")).alias("v"),
    ).where(F.schema_of_variant("v").startswith("OBJECT"))
    keys = rooted.sparkSession.tvf.variant_explode(F.col("v").outer())
    entries = rooted.lateralJoin(keys).select(*by, "_prefix", "key", "value")
    kind = F.regexp_extract(F.schema_of_variant("value"), r"^([A-Z]+)", 1)
    simple = (
        F.when(kind == "VOID", F.lit("null"))
        .when(kind == "BOOLEAN", F.lit("bool"))
        .when(kind == "STRING", F.lit("str"))
        .when(kind == "ARRAY", F.lit("array"))
        .when(kind == "OBJECT", F.lit("object"))
        .otherwise(F.lit("num"))
    )
    text = F.to_json("value")
    size = F.when(simple == "array", F.json_array_length(text)).when(simple == "object", F.size(F.json_object_keys(text)))
    return (
        entries.select(*by, F.concat("_prefix", "key").alias("path"), simple.alias("kind"), F.to_json("value").alias("_text"), size.alias("_size"))
        .groupBy(*by, "path", "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.substring("_text", 1, 60)).alias("sample"), F.min("_size").alias("least_size"), F.max("_size").alias("most_size"))
    )
