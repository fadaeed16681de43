"""Column lists of the entity tables, their keys and partition columns."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


ENTITY_DDL = {
    "daily_health": (
        "profile_id INT, date DATE, steps INT, step_goal INT, total_calories INT, active_calories INT, "
        "bmr_calories INT, resting_hr INT, sleep_seconds INT, deep_sleep_seconds INT, light_sleep_seconds INT, "
        "rem_sleep_seconds INT, sleep_score INT, avg_stress INT, max_stress INT, body_battery_start INT, "
        "body_battery_end INT, hrv_weekly_avg INT, hrv_last_night INT, hrv_status STRING, avg_respiration DOUBLE, "
        "avg_spo2 INT, lowest_spo2 INT, hydration_ml INT, moderate_intensity_min INT, vigorous_intensity_min INT, "
        "consumed_calories INT"
    ),
    "performance_metrics": (
        "profile_id INT, date DATE, vo2max DOUBLE, fitness_age INT, training_readiness INT, training_status STRING, "
        "race_5k_sec INT, race_10k_sec INT, race_half_sec INT, race_marathon_sec INT, endurance_score INT, hill_score INT"
    ),
    "activities": (
        "activity_id BIGINT, profile_id INT, activity_name STRING, activity_type STRING, "
        "start_time_local TIMESTAMP_NTZ, start_time_gmt TIMESTAMP_NTZ, duration_sec DOUBLE, distance_m DOUBLE, "
        "calories INT, avg_hr INT, max_hr INT, avg_speed DOUBLE, max_speed DOUBLE, elevation_gain DOUBLE, "
        "elevation_loss DOUBLE, avg_cadence DOUBLE, avg_power INT, normalized_power INT, training_effect DOUBLE, "
        "training_load DOUBLE, start_lat DOUBLE, start_lon DOUBLE, end_lat DOUBLE, end_lon DOUBLE, "
        "ground_contact_time DOUBLE, vertical_oscillation DOUBLE, stride_length DOUBLE, location_name STRING, raw_json STRING"
    ),
    "activity_details": (
        "activity_id BIGINT, row_pos BIGINT, timestamp_ms BIGINT, elapsed_sec DOUBLE, heart_rate INT, cadence INT, "
        "speed DOUBLE, altitude DOUBLE, distance DOUBLE, power INT, temperature DOUBLE, ground_contact_time DOUBLE, "
        "vertical_oscillation DOUBLE, stride_length DOUBLE, ground_contact_balance DOUBLE, respiration_rate DOUBLE, "
        "lat DOUBLE, lon DOUBLE"
    ),
    "activity_splits": (
        "activity_id BIGINT, split_number INT, split_type STRING, distance_m DOUBLE, duration_sec DOUBLE, "
        "avg_speed DOUBLE, avg_hr INT, max_hr INT, avg_cadence DOUBLE, avg_power DOUBLE, elevation_gain DOUBLE, "
        "elevation_loss DOUBLE, start_lat DOUBLE, start_lon DOUBLE, avg_ground_contact_time DOUBLE, "
        "avg_vertical_oscillation DOUBLE, avg_stride_length DOUBLE"
    ),
    "weight": (
        "profile_id INT, date DATE, timestamp_gmt STRING, sample_pk BIGINT, weight_kg DOUBLE, weight_grams DOUBLE, "
        "bmi DOUBLE, body_fat DOUBLE, body_water DOUBLE, bone_mass DOUBLE, muscle_mass DOUBLE, physique_rating INT, "
        "visceral_fat DOUBLE, metabolic_age INT, source_type STRING"
    ),
    "blood_pressure": (
        "profile_id INT, date DATE, timestamp_gmt STRING, timestamp_local STRING, systolic INT, diastolic INT, "
        "pulse INT, category INT, category_name STRING, notes STRING, source_type STRING, version INT"
    ),
    "nutrition": (
        "profile_id INT, date DATE, consumed_calories INT, protein_g DOUBLE, carbs_g DOUBLE, fat_g DOUBLE"
    ),
    "raw_payloads": (
        "profile_id INT, endpoint STRING, key_date DATE, activity_id BIGINT, payload STRING, ingest_seq BIGINT"
    ),
}

# Upsert keys per entity, after the profile.
ENTITY_KEYS = {
    "daily_health": ["profile_id", "date"],
    "performance_metrics": ["profile_id", "date"],
    "activities": ["profile_id", "activity_id"],
    "weight": ["profile_id", "date", "sample_pk", "timestamp_gmt"],
    "blood_pressure": ["profile_id", "date", "timestamp_gmt"],
    "nutrition": ["profile_id", "date"],
    "activity_details": ["activity_id", "row_pos"],
    "activity_splits": ["activity_id", "split_number"],
}

# Partition columns of the stored tables. Monthly and ISO-week partitions are
# derived from the date; per-activity tables hash into a fixed number of folders
# through ``activity_slot`` instead of one file per activity.
MONTHLY = ["ym"]
WEEKLY = ["iso_week"]
SLOTTED = ["activity_slot"]
ACTIVITY_SLOTS = 64
ENTITY_PARTITIONS = {
    "daily_health": MONTHLY,
    "performance_metrics": MONTHLY,
    "weight": MONTHLY,
    "blood_pressure": MONTHLY,
    "nutrition": MONTHLY,
    "activities": WEEKLY,
    "activity_details": SLOTTED,
    "activity_splits": SLOTTED,
}


def entity_schema(name: str) -> T.StructType:
    return _schema(ENTITY_DDL[name])
