"""SQL of the nine-feature least-squares fits and of the signals they split."""

from __future__ import annotations

from ..plans import decompose

LOADED = """(SELECT *, distance_7d_km * distance_7d_km AS distance_7d_km_sq FROM (
  SELECT *, CASE WHEN count(*) OVER w7 >= 7 THEN sum(distance_today_km) OVER w7 END AS distance_7d_km, CASE WHEN count(*) OVER w28 >= 28 THEN sum(distance_today_km) OVER w28 END AS distance_28d_km,
    CASE WHEN count(*) OVER w90 >= 90 THEN sum(distance_today_km) OVER w90 END AS distance_90d_km, CASE WHEN count(*) OVER w7 >= 7 THEN sum(cross_train_today_km) OVER w7 END AS cross_train_7d_km,
    CASE WHEN count(sleep_hours_last_night) OVER w7 >= 5 THEN avg(sleep_hours_last_night) OVER w7 END AS sleep_hours_prior_7d
  FROM load_spine WINDOW w7 AS (PARTITION BY profile_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
    w28 AS (PARTITION BY profile_id ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), w90 AS (PARTITION BY profile_id ORDER BY date ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)))"""
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in decompose.DECOMPOSE_FEATURES)


def solved_sql(src: str, xs: list[str], y: str, min_n: int = 100) -> str:
    """Least squares with many features as SQL: Gaussian elimination of the scaled normal equations, one step per level."""
    k = range(len(xs))
    moments = [f"corr(x{i}, x{j}) AS a_{i}_{j}" for i in k for j in k if i < j] + [f"corr(x{i}, y) AS b_{i}" for i in k]
    moments += [f"stddev_pop(x{i}) AS s_{i}, avg(x{i}) AS m_{i}" for i in k] + ["stddev_pop(y) AS s_y, avg(y) AS m_y"]
    columns = ", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(xs))
    sql = f"SELECT profile_id, count(*) AS n, {', '.join(moments)} FROM (SELECT profile_id, {columns}, CAST({y} AS DOUBLE) AS y FROM {src}) GROUP BY 1 HAVING count(*) >= {min_n}"
    sql = f"SELECT *, {', '.join(f'1e0 AS a_{i}_{i}' for i in k)} FROM ({sql})"
    for p in k[:-1]:
        steps = [f"a_{i}_{j} - a_{p}_{i} * a_{p}_{j} / a_{p}_{p} AS a_{i}_{j}" for i in k for j in k if p < i <= j]
        steps += [f"b_{i} - a_{p}_{i} * b_{p} / a_{p}_{p} AS b_{i}" for i in k if i > p]
        sql = f"SELECT * REPLACE ({', '.join(steps)}) FROM ({sql})"
    for i in reversed(k):
        known = "".join(f" - a_{i}_{j} * z_{j}" for j in k if j > i)
        sql = f"SELECT *, (b_{i}{known}) / a_{i}_{i} AS z_{i} FROM ({sql})"
    sql = f"SELECT profile_id, n, m_y, {', '.join(f'm_{i}, z_{i} * s_y / s_{i} AS c_{i}' for i in k)} FROM ({sql})"
    return f"SELECT *, m_y - ({' + '.join(f'c_{i} * m_{i}' for i in k)}) AS intercept FROM ({sql})"


SOLVED = {t: solved_sql(f"{LOADED} WHERE {COMPLETE} AND {t} IS NOT NULL", decompose.DECOMPOSE_FEATURES, t) for t, _ in decompose.DECOMPOSE_TARGETS}
_FITTED = " + ".join(f"c_{i} * {x}" for i, x in enumerate(decompose.DECOMPOSE_FEATURES))


def _split_sql(target: str, label: str) -> str:
    return f"""(SELECT profile_id, date, {target} AS {label}, intercept + {_FITTED} AS {label}_training, {target} - (intercept + {_FITTED}) AS {label}_external
      FROM (SELECT * FROM {LOADED} WHERE {COMPLETE} AND {target} IS NOT NULL) JOIN ({SOLVED[target]}) USING (profile_id))"""


DECOMPOSED_SQL = f"""SELECT coalesce(s.profile_id, r.profile_id) AS profile_id, coalesce(s.date, r.date) AS date, s.* EXCLUDE (profile_id, date), r.* EXCLUDE (profile_id, date)
  FROM {_split_sql('avg_stress', 'stress')} s FULL JOIN {_split_sql('resting_hr', 'rhr')} r ON s.profile_id = r.profile_id AND s.date = r.date"""
