"""DuckDB SQL for the registered queries, on the same generic tables and with the same fixed expressions."""

from __future__ import annotations

_TZ = "America/Los_Angeles"
_LOCAL = lambda t: f"timezone('{_TZ}', timezone('UTC', {t}))"
_DAY = lambda t: f"CAST({_LOCAL(t)} AS DATE)"
_UTC = lambda day: f"timezone('UTC', timezone('{_TZ}', CAST({day} AS TIMESTAMP)))"
_T = lambda t: f"strftime({t}, '%Y-%m-%d %H:%M:%S')"
_S = lambda t: f"CAST(epoch({t}) AS BIGINT)"
_FOOD = "('user_meal','user_meal_and_correction','override_up')"
_TIR = "coalesce(round(100.0*count(*) FILTER (bg BETWEEN 70 AND 180)/nullif(count(bg),0),4),0)"

BASE = f"""
ev AS (SELECT event_id AS seqnum, date_trunc('second', ts) AS ts, CAST(user_id // 75 AS VARCHAR) AS pump, event_type AS et, value AS v,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events),
cgm AS (SELECT *, {_S('ts')} AS t, {_LOCAL('ts')} AS l, {_DAY('ts')} AS day
        FROM (SELECT pump, seqnum, ts, CAST(floor(least(400.0, 40 + 2*v)) AS INTEGER) AS bg, et = 'error' AS backfilled
        FROM ev)),
bolus AS (SELECT pump, seqnum, ts, v/20 AS units, {_DAY('ts')} AS day FROM ev WHERE et = 'purchase'),
req0 AS (SELECT pump, seqnum, ts, k, v, CAST(floor(least(400.0, 40 + 2*v)) AS INTEGER) AS bg, v/100 AS iob,
  CASE WHEN k % 7 = 0 OR k % 9 > 7 THEN 'unknown' WHEN k % 9 IN (3,6) THEN 'auto' WHEN k % 2 = 1 THEN 'override' ELSE 'user' END AS src,
  CASE WHEN k % 5 = 0 THEN 0.0 ELSE v/25 END AS f0, CASE WHEN k % 3 = 0 THEN v/50 ELSE 0.0 END AS c0,
        CASE k % 4 WHEN 1 THEN 0.5 WHEN 2 THEN -0.25 ELSE 0.0 END AS x
        FROM ev
        WHERE et IN ('purchase','signup')),
req1 AS (SELECT pump, seqnum, ts, k AS carbs, bg, iob, src, CASE WHEN k % 11 <> 0 THEN f0 END AS food,
        CASE WHEN k % 11 <> 0 THEN c0 END AS fix, CASE WHEN k % 11 <> 0 THEN f0 + c0 + x END AS total
        FROM req0),
req2 AS (SELECT *, coalesce(total,0) - (coalesce(food,0) + coalesce(fix,0)) AS delta,
  CASE WHEN carbs > 0 AND coalesce(food,0) > 0 AND coalesce(fix,0) > 0 THEN 'user_meal_and_correction' WHEN carbs > 0 AND coalesce(food,0) > 0 THEN 'user_meal' WHEN carbs <= 0 AND coalesce(fix,0) > 0 THEN 'user_correction_only' ELSE 'unknown' END AS usr
        FROM req1),
req AS (SELECT *, {_S('ts')} AS t, {_DAY('ts')} AS day,
        CASE WHEN src = 'auto' THEN 'auto_correction' WHEN src = 'override' AND delta > 0.01 THEN 'override_up' WHEN src = 'override' AND delta < -0.01 THEN 'override_down' WHEN src IN ('override','user') THEN usr ELSE 'unknown' END AS cat
        FROM req2),
basal AS (SELECT pump, seqnum, ts, CAST(floor(v*20) AS BIGINT) AS milli, CAST(floor(v*20) AS BIGINT)/1000.0::DOUBLE AS rate, k % 6 AS code,
        {_DAY('ts')} AS day
        FROM ev
        WHERE et = 'view'),
alarms AS (SELECT pump, seqnum, ts, k, {_DAY('ts')} AS day, CASE k % 3 WHEN 0 THEN 'activated' WHEN 1 THEN 'cleared' ELSE 'ack' END AS action,
  CASE k % 4 WHEN 0 THEN 'OcclusionAlarm' WHEN 1 THEN 'cgm_out_of_range' WHEN 2 THEN 'BatteryShutdownAlarm' ELSE 'LowInsulinAlert' END AS name
        FROM ev
        WHERE et IN ('error','click')),
sites AS (SELECT pump, seqnum, ts, k, CASE k % 3 WHEN 0 THEN 'cartridge' WHEN 1 THEN 'cannula' ELSE 'tubing' END AS sub FROM ev WHERE et = 'signup'),
forced AS (SELECT s.*, EXISTS (SELECT 1
        FROM alarms a
        WHERE a.pump = s.pump AND a.name = 'BatteryShutdownAlarm' AND a.action = 'activated' AND a.ts <= s.ts AND s.ts <= a.ts + INTERVAL 120 MINUTE) AND NOT (sub = 'cartridge' AND k*3 >= 220) AS forced
        FROM sites s),
gap0 AS (SELECT pump, seqnum, ts, action, lead(ts) OVER (PARTITION BY pump ORDER BY ts, seqnum) AS e
        FROM alarms
        WHERE name = 'cgm_out_of_range' AND action IN ('activated','cleared')),
gaps AS (SELECT pump, seqnum, ts AS s, e FROM gap0 WHERE action = 'activated'),
sus0 AS (SELECT pump, seqnum, ts, k, v, k % 2 = 0 AS open, lead(ts) OVER w AS e, lead(k % 2 = 0) OVER w AS eo
        FROM ev
        WHERE et = 'click'
        WINDOW w AS (PARTITION BY pump ORDER BY ts, seqnum)),
sus AS (SELECT pump, seqnum, ts AS s, e, k, v, eo, (epoch_us(e) - epoch_us(ts))/60e6 AS mins FROM sus0 WHERE open)
"""
_PCT = lambda c: f"coalesce(100.0*count(*) FILTER ({c})/nullif(count(bg),0), 0)"
_RISK = "(1.509*(pow(ln(least(greatest(CAST(bg AS DOUBLE),20.0),600.0)),1.084)-5.381))"

_MODD = f"""modd0 AS (SELECT grp, day, abs(bg - lag(bg) OVER (PARTITION BY grp, hour(l)*3600+minute(l)*60+CAST(second(l) AS INT) ORDER BY day,
        seqnum)) AS diff
        FROM rows),
modd AS (SELECT grp, CASE WHEN count(DISTINCT day) >= 2 THEN avg(diff) END AS modd FROM modd0 GROUP BY grp)"""
_CONGA = """conga0 AS (SELECT a.grp, a.seqnum, a.bg - b.bg AS diff, row_number() OVER (PARTITION BY a.grp, a.seqnum ORDER BY abs(b.t - (a.t - 3600)),
        CASE WHEN b.t <= a.t - 3600 THEN 0 ELSE 1 END, CASE WHEN b.t <= a.t - 3600 THEN -b.seqnum ELSE b.seqnum END) AS rn
        FROM rows a
        JOIN rows b ON a.grp = b.grp AND b.t BETWEEN a.t - 3750 AND a.t - 3450),
conga AS (SELECT grp, stddev_samp(diff) AS conga FROM conga0 WHERE rn = 1 GROUP BY grp)"""
_MAGE = """mage0 AS (SELECT grp, ts, seqnum, CAST(bg AS DOUBLE) AS bg, lead(bg) OVER w - bg AS df, lag(bg) OVER w IS NULL AS isfirst
        FROM rows
        WINDOW w AS (PARTITION BY grp ORDER BY ts, seqnum)),
mage1 AS (SELECT grp, seqnum, sign(df) <> lag(sign(df)) OVER (PARTITION BY grp ORDER BY ts, seqnum) AS turn FROM mage0 WHERE df <> 0),
mage2 AS (SELECT m.grp, abs(m.bg - lag(m.bg) OVER (PARTITION BY m.grp ORDER BY m.ts, m.seqnum)) AS a
        FROM mage0 m
        WHERE m.isfirst OR m.df IS NULL OR EXISTS (SELECT 1
        FROM mage1 x
        WHERE x.grp = m.grp AND x.seqnum = m.seqnum AND x.turn)),
magesd AS (SELECT grp, stddev_samp(bg) AS sd, count(bg) AS n FROM mage0 GROUP BY grp),
mage AS (SELECT s.grp, CASE WHEN s.n >= 3 THEN coalesce((SELECT avg(a)
        FROM mage2 x
        WHERE x.grp = s.grp AND x.a > s.sd), 0) END AS mage
        FROM magesd s)"""


def _report(group: str) -> str:
    return f"""WITH {BASE}, rows AS (SELECT *, {group} AS grp
        FROM cgm
        WHERE ts >= TIMESTAMP '2024-01-01 08:00:00' AND ts < TIMESTAMP '2024-01-31 08:00:00'), {_MODD}, {_CONGA}, {_MAGE},
one AS (SELECT grp, count(bg) AS n_readings, count(*) AS n_rows, count(DISTINCT day) AS n_days, {_PCT('bg < 54')} AS tbr_level2,
        {_PCT('bg >= 54 AND bg < 70')} AS tbr_level1, {_PCT('bg BETWEEN 70 AND 180')} AS tir, {_PCT('bg > 180 AND bg <= 250')} AS tar_level1,
        {_PCT('bg > 250')} AS tar_level2, {_PCT('bg < 70')} AS tbr_total, {_PCT('bg > 180')} AS tar_total, {_PCT('bg BETWEEN 70 AND 140')} AS titr,
        100.0*count(*) FILTER (bg BETWEEN 70 AND 180)/nullif(count(bg),0) AS tir_config,
 avg(bg) AS mean_bg, quantile_cont(CAST(bg AS DOUBLE), 0.5) AS median_bg, stddev_samp(bg) AS sd_bg,
        avg(CASE WHEN {_RISK} < 0 THEN 10*{_RISK}*{_RISK} ELSE 0 END) AS lbgi, avg(CASE WHEN {_RISK} > 0 THEN 10*{_RISK}*{_RISK} ELSE 0 END) AS hbgi,
        min(ts) AS f, max(ts) AS g, 100.0*count(*)/8640 AS active
        FROM rows
        GROUP BY grp)
SELECT o.grp, n_readings, n_rows, n_days, round(tbr_level2,4) AS tbr_level2, round(tbr_level1,4) AS tbr_level1, round(tir,4) AS tir,
        round(tar_level1,4) AS tar_level1, round(tar_level2,4) AS tar_level2, round(tbr_total,4) AS tbr_total, round(tar_total,4) AS tar_total,
        round(titr,4) AS titr, round(tir_config,4) AS tir_config, round(mean_bg,4) AS mean_bg, round(median_bg,4) AS median_bg,
        round(sd_bg,4) AS sd_bg, round(lbgi,4) AS lbgi, round(hbgi,4) AS hbgi,
 {_T('f')} AS first_ts, {_T('g')} AS last_ts, CAST(8640 AS BIGINT) AS n_expected, round(active,4) AS active_percent,
        n_days >= 14 AND active >= 70 AS sufficient, round(100*sd_bg/mean_bg,4) AS cv_percent,
        round(CASE WHEN n_days >= 14 AND active >= 70 THEN 3.31+0.02392*mean_bg END,4) AS gmi, round((mean_bg+46.7)/28.7,4) AS ea1c,
 round(CASE WHEN n_days >= 14 AND active >= 70 THEN least(100.0, greatest(0.0,
        3.0*(tbr_level2+0.8*tbr_level1)+1.6*(tar_level2+0.5*tar_level1))) END,4) AS gri,
        round(CASE WHEN n_days >= 14 AND active >= 70 THEN tbr_level2+0.8*tbr_level1 END,4) AS gri_hypo,
        round(CASE WHEN n_days >= 14 AND active >= 70 THEN tar_level2+0.5*tar_level1 END,4) AS gri_hyper,
        round(0.001*(mean_bg+sd_bg)*(mean_bg+sd_bg),4) AS j_index, 100*sd_bg/mean_bg <= 36 AS cv_stable, round(modd,4) AS modd,
        round(conga,4) AS conga, round(mage,4) AS mage
FROM one o LEFT JOIN modd USING (grp) LEFT JOIN conga USING (grp) LEFT JOIN mage USING (grp)"""


_WIN = """win AS (SELECT a.pump, a.seqnum, a.ts, a.t, a.l, count(*) AS n, sum(b.bg) AS sum_bg, arg_min(b.bg, (b.t, b.seqnum)) AS v0, arg_max(b.bg,
        (b.t, b.seqnum)) AS v1, string_agg(CAST(b.bg AS VARCHAR), ',' ORDER BY b.t, b.seqnum) AS vals
        FROM cgm a
        JOIN cgm b ON a.pump = b.pump AND b.t BETWEEN a.t - 3600 AND a.t
        GROUP BY ALL),
wl AS (SELECT a.pump, a.seqnum, list({'t': b.t, 'v': b.bg}) AS ls
        FROM cgm a
        JOIN cgm b ON a.pump = b.pump AND b.t BETWEEN a.t - 3600 AND a.t
        GROUP BY ALL),
wx AS (SELECT pump, seqnum, ls, unnest(ls) AS x FROM wl), wy AS (SELECT pump, seqnum, x, unnest(ls) AS y FROM wx),
slp AS (SELECT pump, seqnum, median((y.v - x.v)*60.0/(y.t - x.t)) AS slope FROM wy WHERE y.t > x.t GROUP BY ALL),
ris AS (SELECT w.*, slope, CAST(hour(l) AS INTEGER) AS h, n/7.0::DOUBLE AS coverage,
        CASE WHEN hour(l) BETWEEN 6 AND 10 OR hour(l) BETWEEN 11 AND 14 OR hour(l) BETWEEN 17 AND 21 THEN 0.7 ELSE 1.3 END::DOUBLE AS mult
        FROM win w
        JOIN slp USING (pump, seqnum)
        WHERE n >= 4 AND n/7.0 >= 0.5 AND v0 BETWEEN 70 AND 250),
det AS (SELECT * FROM ris WHERE slope >= 1.8*mult)"""
_THIN = """, inst0 AS (SELECT pump, min(t) AS t
        FROM det
        GROUP BY pump
        UNION ALL SELECT i.pump, (SELECT min(d.t)
        FROM det d
        WHERE d.pump = i.pump AND d.t >= i.t + 3600) AS t
        FROM inst0 i
        WHERE i.t IS NOT NULL),
inst AS (SELECT d.* FROM det d JOIN (SELECT DISTINCT pump, t FROM inst0 WHERE t IS NOT NULL) i ON d.pump = i.pump AND d.t = i.t)"""
_SCORE = f""", food AS (SELECT i.pump, i.seqnum, r.t AS ft, r.cat, r.carbs, row_number() OVER (PARTITION BY i.pump,
        i.seqnum ORDER BY abs(r.t - (i.t-3600)), r.t, r.seqnum) AS rn
        FROM inst i
        JOIN req r ON r.pump = i.pump AND r.cat IN {_FOOD} AND r.t BETWEEN i.t - 3600 - 1800 AND i.t - 3600 + 2700),
fixs AS (SELECT i.pump, i.seqnum, r.t AS xt, r.cat, row_number() OVER (PARTITION BY i.pump, i.seqnum ORDER BY r.t, r.seqnum) AS rn
        FROM inst i
        JOIN req r ON r.pump = i.pump AND r.cat IN ('user_correction_only','auto_correction') AND r.t BETWEEN i.t - 3600 AND i.t - 3600 + 10800),
sc AS (SELECT i.pump, i.seqnum, i.ts, i.t, i.v0, i.v1, i.h, f.ft, f.cat AS fcat, f.carbs, x.xt,
        CASE WHEN f.ft IS NULL THEN 'uncovered' WHEN f.ft < i.t - 3600 THEN 'pre_bolused' ELSE 'late_bolused' END AS label,
        CASE WHEN f.ft IS NULL THEN CASE WHEN x.cat = 'auto_correction' THEN 'auto_correction' WHEN x.cat IS NOT NULL THEN 'user_correction' ELSE 'none' END END AS resolution

        FROM inst i
        LEFT
        JOIN food f ON f.pump = i.pump AND f.seqnum = i.seqnum AND f.rn = 1
        LEFT
        JOIN fixs x ON x.pump = i.pump AND x.seqnum = i.seqnum AND x.rn = 1)"""
#: Doses in thousandths of a unit times microseconds an hour, as integers; 3.6e12 of them are one unit.
_BAS = f"""bas0 AS (SELECT pump, day, milli, epoch_us(coalesce(lead(ts) OVER (PARTITION BY pump, day ORDER BY ts, seqnum),
        {_UTC('day + 1')})) - epoch_us(ts) AS us
        FROM basal),
bas AS (SELECT pump, day, sum(milli * greatest(us, 0)) AS dose, CAST(sum(milli * greatest(us, 0)) AS DOUBLE)/3.6e12 AS u
        FROM bas0
        GROUP BY pump, day)"""
_UNITS = "CAST(sum(CAST(units AS DECIMAL(20,6))) AS DOUBLE)"
_SOURCE = "CASE code WHEN 0 THEN 'suspended' WHEN 1 THEN 'profile' WHEN 2 THEN 'temp_rate' WHEN 3 THEN 'algorithm' WHEN 4 THEN 'temp_rate_and_algorithm' ELSE 'unknown' END"
_ROUGH = "sum(milli)*5/60000.0::DOUBLE"
_CLUS = "bc0 AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY pump ORDER BY ts, seqnum)) <= 1800 THEN 0 ELSE 1 END AS nw FROM bolus), bc1 AS (SELECT *, sum(nw) OVER (PARTITION BY pump ORDER BY ts, seqnum) AS ses FROM bc0), bc AS (SELECT pump, ses, min(ts) AS f, list(ts ORDER BY ts, seqnum)[count(*)//2 + 1] AS c, sum(units) AS u, count(*) AS n FROM bc1 GROUP BY pump, ses)"


def _overlap(table: str, s: str, e: str, name: str) -> str:
    end = f"coalesce({e}, {_UTC(chr(39) + '2024-01-31' + chr(39))})"
    return f"""{name} AS (SELECT pump, day, sum(greatest(0.0, (epoch_us(least(e, {_UTC('day + 1')})) - epoch_us(greatest(s, {_UTC('day')})))/60e6)) AS m
        FROM (SELECT pump, {s} AS s, {end} AS e, CAST(unnest(generate_series({_DAY(s)}::TIMESTAMP, {_DAY(end)}::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day
        FROM {table}
        WHERE {end} >= {s})
        GROUP BY pump, day)"""


def _with(sql: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join((BASE, *more))} {sql}"


_OC = (
    "o0 AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY pump ORDER BY ts, seqnum)) <= 10800 THEN 0 ELSE 1 END AS nw FROM alarms WHERE name = 'OcclusionAlarm' AND action = 'activated')",
    "o1 AS (SELECT *, sum(nw) OVER (PARTITION BY pump ORDER BY ts, seqnum) AS ses FROM o0)",
    "oc AS (SELECT pump, ses, min(ts) AS f, max(ts) AS g, count(*) AS n FROM o1 GROUP BY pump, ses HAVING count(*) >= 2)",
)
_SPINE = "CAST(unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day"
ORACLE_SQL: dict[str, str] = {
    "cgm_report_pooled": _report("'all'"),
    "cgm_report_by_pump": _report("pump"),
    "report_segments": f"""
        WITH x AS ({_report(chr(39) + 'all' + chr(39))}),
        y AS (
            SELECT band, p, sufficient, n_days
        FROM x, LATERAL (VALUES ('tbr_level2', tbr_level2), ('tbr_level1', tbr_level1), ('tir', tir), ('tar_level1', tar_level1), ('tar_level2',
        tar_level2), ('gmi', gmi)) v(band, p)
        )
        SELECT band, greatest(coalesce(p, 0.0), 0.0) AS percent, coalesce(CAST(round_even(p, 0) AS INTEGER) || ' %', '—') AS shown,
            CASE WHEN NOT sufficient THEN 'needs 14 days and 70 % of readings; has ' || n_days || ' days' END AS note
        FROM y""",
    "cgm_built": _with(f""", lagged AS (SELECT *, lag(ts2) OVER (PARTITION BY pump ORDER BY ts2, seqnum) AS b
        FROM (SELECT pump, seqnum, et = 'error' AS bf, k*3+40 AS bg,
        CASE WHEN et = 'error' THEN {_UTC('ts - INTERVAL 8 HOUR - to_seconds(k*10)')} ELSE ts END AS ts2, CASE WHEN et = 'error' THEN ts END AS sens
        FROM ev))
 SELECT pump AS pump_serial, seqnum, {_T('ts2')} AS timestamp, CAST(bg AS INTEGER) AS bg_mgdl, bf AS backfilled, {_T('sens')} AS sensor_timestamp
        FROM lagged
        WHERE b IS NULL OR epoch_us(ts2) - epoch_us(b) >= 60000000 OR bf"""),
    "requests_joined": _with(f"""SELECT pump AS pump_serial, seqnum AS bolus_id, {_T('ts')} AS timestamp, carbs AS carbs_g, bg AS bg_mgdl, round(iob,4) AS iob,
        src AS bolus_source, round(food,4) AS food_insulin, round(fix,4) AS correction_insulin, round(total,4) AS total_requested
        FROM req"""),
    "orphan_messages": _with("SELECT pump AS pump_serial, seqnum AS bolus_id, k % 9 AS options, k % 2 AS user_override FROM ev WHERE et = 'error' AND k % 7 <> 0"),
    "requests_enriched": _with(f"""SELECT pump AS pump_serial, seqnum AS bolus_id, {_T('ts')} AS timestamp, carbs AS carbs_g, bg AS bg_mgdl, round(iob,4) AS iob,
        src AS bolus_source, round(food,4) AS food_insulin, round(fix,4) AS correction_insulin, round(total,4) AS total_requested,
        cat AS bolus_category, round(CASE WHEN src = 'override' THEN delta END,4) AS override_delta
        FROM req"""),
    "basal_built": _with(f"""SELECT pump AS pump_serial, {_T('ts')} AS timestamp, round(rate,4) AS commanded_rate,
        CASE code WHEN 0 THEN 'suspended' WHEN 1 THEN 'profile' WHEN 2 THEN 'temp_rate' WHEN 3 THEN 'algorithm' WHEN 4 THEN 'temp_rate_and_algorithm' ELSE 'unknown' END AS rate_source
        FROM basal"""),
    "alarms_built": _with(f"""
        SELECT pump AS pump_serial, seqnum, {_T('ts')} AS timestamp, category,
        CASE k % 2 WHEN 0 THEN 'activated' ELSE 'cleared' END AS action, id AS alarm_id,
            CASE
                WHEN category = 'alert' AND id = 50 THEN 'high_bg_alert'
                WHEN category = 'alert' AND id = 51 THEN 'low_bg_alert'
                WHEN category = 'cgm_alert' AND id = 1 THEN 'cgm_urgent_low'
                WHEN category = 'cgm_alert' AND id = 2 THEN 'cgm_high'
                WHEN category = 'cgm_alert' AND id = 3 THEN 'cgm_low'
                WHEN category = 'cgm_alert' AND id = 6 THEN 'cgm_rise_rate'
                WHEN category = 'cgm_alert' AND id = 8 THEN 'cgm_fall_rate'
                WHEN category = 'cgm_alert' AND id = 14 THEN 'cgm_out_of_range'
                WHEN k % 7 = 0 THEN 'NamedAlarm'
                WHEN category = 'cgm_alert' THEN 'unknown_' || id
                ELSE category || '_' || id
            END AS alarm_name,
            round(v, 4) AS param1, CASE WHEN k % 3 <> 0 THEN round(k * 2.0::DOUBLE, 4) END AS param2
        FROM (
            SELECT *, CASE k % 3 WHEN 0 THEN 'cgm_alert' WHEN 1 THEN 'alert' ELSE 'alarm' END AS category,
        CASE k % 3 WHEN 0 THEN k % 16 WHEN 1 THEN k % 60 ELSE k % 30 END AS id
            FROM ev WHERE et = 'error'
        )"""),
    "pump_events_built": _with(f"""
        SELECT pump AS pump_serial, seqnum, {_T('ts')} AS timestamp,
            CASE WHEN kind < 3 THEN 'site_change' WHEN kind < 5 THEN 'cgm_session' WHEN kind = 5 THEN 'mode_change' WHEN kind = 6 THEN 'pcm_change' ELSE 'daily_marker' END AS event_type,
            CASE kind
                WHEN 0 THEN 'cartridge' WHEN 1 THEN 'cannula' WHEN 2 THEN 'tubing' WHEN 3 THEN 'join' WHEN 4 THEN 'stop'
                WHEN 5 THEN CASE code WHEN 0 THEN 'normal' WHEN 1 THEN 'sleeping' WHEN 2 THEN 'exercising' WHEN 3 THEN 'eating_soon' ELSE 'unknown_' || code END
                WHEN 6 THEN CASE code WHEN 0 THEN 'no_control' WHEN 1 THEN 'open_loop' WHEN 2 THEN 'pining' WHEN 3 THEN 'closed_loop' ELSE 'unknown_' || code END
                WHEN 7 THEN 'new_day' ELSE 'daily_status'
            END AS event_subtype,
            CASE WHEN kind = 5 THEN CASE prev WHEN 0 THEN 'normal' WHEN 1 THEN 'sleeping' WHEN 2 THEN 'exercising' WHEN 3 THEN 'eating_soon' ELSE 'unknown_' || prev END END AS previous_mode,
            CASE kind
                WHEN 0 THEN '{{"insulin_volume":' || (k * 3) || '}}'
                WHEN 1 THEN '{{"prime_size":' || (k % 25) || '}}'
                WHEN 2 THEN '{{"prime_size":' || (k % 25) || '}}'
                WHEN 5 THEN '{{"requested_action":' || (k % 3) || ',"exercise_time":' || CASE k % 2 WHEN 0 THEN CAST(k AS VARCHAR) ELSE 'null' END || '}}'
                WHEN 6 THEN '{{"previous_pcm":' || prev || '}}'
                WHEN 7 THEN '{{"commanded_basal_rate":' || (k * 10) || '}}'
                WHEN 8 THEN '{{"pump_control_state":' || (k % 4) || ',"user_mode":' || (k % 3) || '}}'
                ELSE '{{}}'
            END AS details
        FROM (SELECT *, k % 10 AS kind, k // 10 % 6 AS code, k // 10 % 5 AS prev FROM ev WHERE et = 'signup')
        WHERE kind < 9"""),
    "live_thinning": _with(f"""SELECT pump AS pump_serial, {_T('b')} AS bucket, {_T('max(ts)')} AS timestamp, arg_max(bg, (ts, seqnum)) AS bg_mgdl
        FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS b
        FROM cgm)
        GROUP BY pump, b"""),
    "suspensions": _with(f"""SELECT s.pump AS pump_serial, {_T('s')} AS suspend_timestamp, {_T('e')} AS resume_timestamp, round(mins,4) AS duration_minutes,
        CASE WHEN s.k % 4 = 0 THEN 'alarm' ELSE 'user' END AS suspend_reason, CAST(floor(v) AS INTEGER) AS insulin_at_suspend,
        coalesce(eo OR mins > 1440, false) AS pairing_suspect,
 CASE WHEN s.k % 4 = 0 THEN a.id END AS alarm_id, CASE WHEN s.k % 4 = 0 THEN a.name END AS alarm_name
        FROM sus s
        LEFT
        JOIN (SELECT pump, ts, arg_min(k, seqnum) AS id, arg_min(name, seqnum) AS name
        FROM alarms
        WHERE k % 4 IN (0, 2) AND action = 'activated'
        GROUP BY pump, ts) a ON a.pump = s.pump AND a.ts = s.s"""),
    "site_changes_forced": _with(f"SELECT pump AS pump_serial, seqnum, {_T('ts')} AS timestamp, 'site_change' AS event_type, sub AS event_subtype, forced AS forced_by_alarm FROM forced"),
    "site_issues": _with(f"""SELECT pump AS pump_serial, {_T('f')} AS first_occlusion_ts, {_T('g')} AS last_occlusion_ts, n AS occlusion_count,
        {_T('r')} AS resolved_by_site_change_ts, round((epoch_us(r) - epoch_us(g))/60e6,4) AS resolution_delay_minutes
        FROM (SELECT *, (SELECT min(x.ts)
        FROM forced x
        WHERE x.pump = c.pump AND x.ts > c.g AND NOT x.forced) AS r
        FROM oc c)""",
        *_OC),
    "cgm_gaps": _with(f"SELECT pump AS pump_serial, {_T('s')} AS start_ts, {_T('e')} AS end_ts, round((epoch_us(e) - epoch_us(s))/60e6,4) AS duration_minutes, e IS NULL AS ongoing FROM gaps"),
    "modd_by_pump": _with("SELECT grp AS pump_serial, round(modd,4) AS modd FROM modd", "rows AS (SELECT *, pump AS grp FROM cgm)", _MODD),
    "conga_1h": _with("SELECT DISTINCT c.pump AS pump_serial, round(conga,4) AS conga FROM cgm c LEFT JOIN conga g ON g.grp = c.pump", "rows AS (SELECT *, pump AS grp FROM cgm)", _CONGA),
    "mage_by_pump": _with("SELECT grp AS pump_serial, round(mage,4) AS mage FROM mage", "rows AS (SELECT *, pump AS grp FROM cgm)", _MAGE),
    "agp_hourly": _with("SELECT CAST(h.h AS INTEGER) AS hour, count(bg) AS n, " + ", ".join(f"round(quantile_cont(CAST(bg AS DOUBLE), {q}),4) AS p{n}" for n, q in (("05", 0.05), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("95", 0.95))) + " FROM range(24) h(h) LEFT JOIN cgm ON hour(l) = h.h GROUP BY h.h"),
    "agp_15min_smoothed": _with("SELECT a.minute, any_value(a.n) AS n, " + ", ".join(f"round(sum(w*b.p{n})/9,4) AS p{n}" for n in ("05", "25", "50", "75", "95")) + " FROM ix a CROSS JOIN (VALUES (-2,1),(-1,2),(0,3),(1,2),(2,1)) z(j, w) JOIN ix b ON b.i = (a.i + j + a.m) % a.m GROUP BY a.minute",
        "pr AS (SELECT CAST((hour(l)*60+minute(l))//15*15 AS INTEGER) AS minute, count(bg) AS n, " + ", ".join(f"quantile_cont(CAST(bg AS DOUBLE), {q}) AS p{n}" for n, q in (("05", 0.05), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("95", 0.95))) + " FROM cgm GROUP BY 1)", "ix AS (SELECT *, row_number() OVER (ORDER BY minute) - 1 AS i, count(*) OVER () AS m FROM pr)"),
    "tir_trend_daily": _with(f"""SELECT CAST(day AS VARCHAR) AS day, round({_PCT('bg < 70')},4) AS below_percent, {_TIR} AS tir_percent,
        round({_PCT('bg > 180')},4) AS above_percent, round({_PCT('bg > 250')},4) AS very_high_percent, round(avg(bg),4) AS mean_bg, count(bg) AS n
        FROM cgm
        GROUP BY day"""),
    "tir_windows": _with(f"""SELECT CAST(d AS INTEGER) AS days, round(100.0*count(*) FILTER (bg BETWEEN 70 AND 180)/nullif(count(bg),0),4) AS tir_percent, count(bg) AS n
        FROM (VALUES (7),(14),(30)) w(d)
        JOIN cgm ON ts < TIMESTAMP '2024-01-31 08:00:00' AND ts >= TIMESTAMP '2024-01-31 08:00:00' - to_days(d)
        GROUP BY d"""),
    "heatmap": _with("SELECT CAST(day AS VARCHAR) AS day, CAST(hour(l) AS INTEGER) AS hour, round(avg(bg),4) AS avg_bg, round(quantile_cont(CAST(bg AS DOUBLE),0.5),4) AS median_bg, count(bg) AS n FROM cgm GROUP BY day, hour(l)"),
    "heatmap_pivot": _with(
        "SELECT CAST(h.h AS INTEGER) AS hour, "
        + ", ".join(f"round(quantile_cont(CAST(bg AS DOUBLE),0.5) FILTER (day = DATE '2024-01-{x}'),4) AS d_202401{x}, count(bg) FILTER (day = DATE '2024-01-{x}') AS n_202401{x}" for x in (10, 11, 12))
        + " FROM range(24) h(h) LEFT JOIN cgm ON hour(l) = h.h GROUP BY h.h"
    ),
    "insulin_daily": _with(f"""SELECT CAST(s.day AS VARCHAR) AS day, round(coalesce(b,0),4) AS bolus_units, round(coalesce(u,0)+1e-9,4) AS basal_units,
        round(coalesce(b,0)+coalesce(u,0)+1e-9,4) AS total_units
        FROM (SELECT {_SPINE}) s
        LEFT
        JOIN (SELECT day, {_UNITS} AS b
        FROM bolus
        GROUP BY day) USING (day)
        LEFT
        JOIN (SELECT day, CAST(sum(dose) AS DOUBLE)/3.6e12 AS u
        FROM bas
        GROUP BY day) USING (day)""", _BAS),
    "insulin_daily_5min": _with(f"""SELECT CAST(s.day AS VARCHAR) AS day, round(coalesce(b,0),4) AS bolus_units, round(coalesce(u,0)+1e-9,4) AS basal_units,
        round(coalesce(b,0)+coalesce(u,0)+1e-9,4) AS total_units
        FROM (SELECT {_SPINE}) s
        LEFT
        JOIN (SELECT day, {_UNITS} AS b
        FROM bolus
        GROUP BY day) USING (day)
        LEFT
        JOIN (SELECT day, {_ROUGH} AS u
        FROM basal
        GROUP BY day) USING (day)"""),
    "day_search": _with("SELECT CAST(day AS VARCHAR) AS day, round(tir,4) AS tir_percent, lows AS low_count, al AS alarm_count, count(*) OVER () AS total FROM f ORDER BY f.day DESC LIMIT 5 OFFSET 5",
        f"""f AS (SELECT c.day, tir, lows, coalesce(al,0) AS al
        FROM (SELECT day, {_PCT('bg BETWEEN 70 AND 180')} AS tir, count(*) FILTER (bg < 70) AS lows
        FROM cgm
        GROUP BY day) c
        LEFT
        JOIN (SELECT day, count(*) FILTER (action = 'activated') AS al
        FROM alarms
        GROUP BY day) a USING (day)
        WHERE tir < 55 AND lows >= 1)"""),
    "status_by_pump": _with(f"""SELECT c.pump AS pump_serial, {_T('lc')} AS last_cgm, lb AS last_bg, {_T('la')} AS last_alarm, ln AS last_alarm_name,
        round(age,4) AS age_minutes, CASE WHEN age <= 15 THEN 'fresh' WHEN age <= 60 THEN 'stale' ELSE 'down' END AS freshness,
        CASE WHEN age < 90 THEN CAST(round_even(age,0) AS INTEGER) || ' min ago' WHEN age < 2880 THEN CAST(round_even(age/60,0) AS INTEGER) || ' h ago' ELSE CAST(round_even(age/1440,0) AS INTEGER) || ' d ago' END AS age

        FROM (SELECT pump, max(ts) AS lc, arg_max(bg, (ts, seqnum)) AS lb, ({_S("TIMESTAMP '2024-01-31'")} - max(t))/60.0::DOUBLE AS age
        FROM cgm
        GROUP BY pump) c
        LEFT
        JOIN (SELECT pump, max(ts) AS la, arg_max(name, (ts, seqnum)) AS ln
        FROM alarms
        WHERE action = 'activated'
        GROUP BY pump) a USING (pump)"""),
    "day_summary": _with(f"""SELECT CAST(c.day AS VARCHAR) AS day, tir AS tir_percent, mean_bg, min_bg, max_bg, sd_bg, readings,
        round(coalesce(bu,0),4) AS bolus_units, coalesce(bn,0) AS bolus_count, round(coalesce(u,0)+1e-9,4) AS basal_units,
        round(coalesce(u5,0)+1e-9,4) AS basal_units_5min, coalesce(c1,0) AS carbs_meals, coalesce(c2,0) AS carbs_all, coalesce(a1,0) AS alarm_count,
        coalesce(a2,0) AS alarm_rows

        FROM (SELECT day, {_TIR} AS tir, round(avg(bg),4) AS mean_bg, min(bg) AS min_bg, max(bg) AS max_bg,
        round(coalesce(stddev_samp(bg),0),4) AS sd_bg, count(bg) AS readings
        FROM cgm
        GROUP BY day) c
        LEFT
        JOIN (SELECT day, {_UNITS} AS bu, count(*) AS bn
        FROM bolus
        GROUP BY day) b USING (day)
        LEFT
        JOIN (SELECT day, CAST(sum(dose) AS DOUBLE)/3.6e12 AS u
        FROM bas
        GROUP BY day) x USING (day)
        LEFT
        JOIN (SELECT day, {_ROUGH} AS u5
        FROM basal
        GROUP BY day) y USING (day)

        LEFT
        JOIN (SELECT day, CAST(coalesce(sum(carbs) FILTER (cat IN {_FOOD}),0) AS BIGINT) AS c1,
        CAST(coalesce(sum(carbs) FILTER (carbs > 0),0) AS BIGINT) AS c2
        FROM req
        GROUP BY day) r USING (day)
        LEFT
        JOIN (SELECT day, count(*) FILTER (action = 'activated') AS a1, count(*) AS a2
        FROM alarms
        GROUP BY day) a USING (day)""", _BAS),
    "compare_days": _with("SELECT minute, round(a.b,4) AS bg_a, round(z.b,4) AS bg_b FROM (SELECT CAST(hour(l)*60+minute(l) AS INTEGER) AS minute, avg(bg) AS b FROM cgm WHERE day = DATE '2024-01-10' GROUP BY 1) a FULL JOIN (SELECT CAST(hour(l)*60+minute(l) AS INTEGER) AS minute, avg(bg) AS b FROM cgm WHERE day = DATE '2024-01-03' GROUP BY 1) z USING (minute)"),
    "bolus_clusters": _with(f"SELECT pump AS pump_serial, {_T('f')} AS first_ts, {_T('c')} AS centre_ts, round(u,4) AS total_units, n FROM bc", _CLUS),
    "cluster_requests": _with(f"""SELECT bc.pump AS pump_serial, {_T('c')} AS centre_ts, CAST(sum(carbs) AS BIGINT) AS carbs_g, arg_max(cat, (coalesce(total,-1),
        seqnum)) AS top_category, count(*) AS n_requests
        FROM bc
        JOIN req r ON r.pump = bc.pump AND r.ts BETWEEN c - INTERVAL 5 MINUTE AND c + INTERVAL 5 MINUTE
        GROUP BY bc.pump, c""", _CLUS),
    "local_peaks": _with(f"""SELECT pump AS pump_serial, seqnum, {_T('ts')} AS timestamp, bg AS bg_mgdl
        FROM (SELECT *, max(bg) OVER (PARTITION BY pump ORDER BY ts, seqnum ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top
        FROM cgm)
        WHERE bg = top AND bg > 180"""),
    "downward_crossings": _with(f"""SELECT pump AS pump_serial, seqnum, {_T('ts')} AS timestamp, CAST(level AS DOUBLE) AS level, b AS before, bg AS bg_mgdl
        FROM (SELECT *, lag(bg) OVER (PARTITION BY pump ORDER BY ts, seqnum) AS b
        FROM cgm)
        JOIN (VALUES (180),(250)) v(level) ON b > level AND bg <= level"""),
    "day_slice_counts": _with(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {src} WHERE ts >= TIMESTAMP '2024-01-10 08:00:00' AND ts < TIMESTAMP '2024-01-11 08:00:00'" for n, src in (("cgm", "cgm"), ("bolus", "bolus"), ("requests", "req"), ("basal", "basal"), ("alarms", "alarms"), ("events", "sites"))) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', count(*) FROM {src} WHERE {a} < TIMESTAMP '2024-01-11 08:00:00' AND ({b} IS NULL OR {b} >= TIMESTAMP '2024-01-10 08:00:00')" for n, src, a, b in (("suspension", "sus", "s", "e"), ("cgm_gaps", "gaps", "s", "e"), ("site_issues", "(SELECT *, (SELECT min(x.ts) FROM forced x WHERE x.pump = c.pump AND x.ts > c.g AND NOT x.forced) AS r FROM oc c)", "f", "r"))), *_OC),
    "table_bounds": _with(f"""SELECT {_T('min(t)')} AS first_ts, {_T('max(t)')} AS last_ts
        FROM (SELECT ts AS t
        FROM cgm
        UNION ALL SELECT ts
        FROM bolus
        UNION ALL SELECT ts
        FROM req
        UNION ALL SELECT ts
        FROM basal
        UNION ALL SELECT ts
        FROM alarms
        UNION ALL SELECT s
        FROM sus
        UNION ALL SELECT s
        FROM gaps
        UNION ALL SELECT f
        FROM oc)""", *_OC),
    "series_breaks": _with("SELECT CASE WHEN bg < 70 THEN 'low' WHEN bg <= 180 THEN 'in_range' WHEN bg <= 250 THEN 'high' ELSE 'very_high' END AS bg_class, b AS is_break, count(*) AS n FROM (SELECT bg, coalesce(t - lag(t) OVER (PARTITION BY pump ORDER BY ts, seqnum) > 900, false) AS b FROM cgm) GROUP BY 1, 2"),
    "gaps_on_day": _with(f"""SELECT pump AS pump_serial, {_T('s')} AS start_ts, round(epoch(greatest(s,
        TIMESTAMP '2024-01-10 08:00:00') - TIMESTAMP '2024-01-10 08:00:00')/60,4) AS start_minute, round(epoch(least(coalesce(e,
        TIMESTAMP '2024-01-11 08:00:00'), TIMESTAMP '2024-01-11 08:00:00') - TIMESTAMP '2024-01-10 08:00:00')/60,4) AS end_minute
        FROM gaps
        WHERE s < TIMESTAMP '2024-01-11 08:00:00' AND (e IS NULL OR e >= TIMESTAMP '2024-01-10 08:00:00')"""),
    "suspensions_overlapping": _with(f"""SELECT pump AS pump_serial, {_T('s')} AS suspend_timestamp, {_T('e')} AS resume_timestamp
        FROM sus
        WHERE s < TIMESTAMP '2024-01-06 08:00:00' AND (e IS NULL OR e >= TIMESTAMP '2024-01-01 08:00:00')"""),
    "out_of_range_shading": _with(f"""SELECT pump AS pump_serial, seqnum, {_T('ts')} AS start_ts,
        {_T('(SELECT min(c.ts) FROM alarms c WHERE c.pump = a.pump AND c.name = a.name AND c.action = ' + chr(39) + 'cleared' + chr(39) + ' AND c.ts > a.ts)')} AS end_ts
        FROM alarms a
        WHERE name = 'cgm_out_of_range' AND action = 'activated'"""),
    "gaps_snapped": _with(f"""SELECT pump AS pump_serial, {_T('s')} AS start_ts, {_T('e')} AS end_ts,
        {_T('(SELECT max(c.ts) FROM cgm c WHERE c.pump = g.pump AND c.ts <= g.s)')} AS snap_start,
        {_T('(SELECT min(c.ts) FROM cgm c WHERE c.pump = g.pump AND c.ts >= g.e)')} AS snap_end
        FROM gaps g
        WHERE e IS NOT NULL"""),
    "daily_features": _with(f"""SELECT c.pump AS pump_serial, CAST(c.day AS VARCHAR) AS day, mean_bg, sd_bg, cv, tir, below, above, severe, n_readings, overnight_dip,
        round(coalesce(bu,0),4) AS bolus_units, round(coalesce(u,0)+1e-9,4) AS basal_units, coalesce(mc,0) AS meal_count, coalesce(cg,0) AS carbs_g,
        coalesce(ac,0) AS alarm_count, round(pk,4) AS postprandial_peak, round(coalesce(sm.m,0),4) AS suspension_minutes,
        round(coalesce(om.m,0),4) AS out_of_range_minutes, round(coalesce(bu,0)+coalesce(u,0)+1e-9,4) AS tdi,
        round(coalesce(u,0)/nullif(bu,0),4) AS basal_bolus_ratio

        FROM (SELECT pump, day, round(avg(bg),4) AS mean_bg, round(stddev_pop(bg),4) AS sd_bg, round(stddev_pop(bg)/avg(bg),4) AS cv,
        round(count(*) FILTER (bg BETWEEN 70 AND 180)/count(bg),4) AS tir, round(count(*) FILTER (bg < 70)/count(bg),4) AS below,
        round(count(*) FILTER (bg > 180 AND bg <= 250)/count(bg),4) AS above, round(count(*) FILTER (bg > 250)/count(bg),4) AS severe,
        count(bg) AS n_readings,
  round(avg(bg) FILTER (ts >= {_UTC('day')} + INTERVAL 4 HOUR AND ts < {_UTC('day')} + INTERVAL 6 HOUR) - avg(bg) FILTER (ts < {_UTC('day')} + INTERVAL 2 HOUR),4) AS overnight_dip
        FROM cgm
        GROUP BY pump, day) c

        LEFT
        JOIN (SELECT pump, day, {_UNITS} AS bu
        FROM bolus
        GROUP BY ALL) b USING (pump, day)
        LEFT
        JOIN bas USING (pump, day)
        LEFT
        JOIN (SELECT pump, day, count(*) FILTER (cat IN {_FOOD}) AS mc, CAST(coalesce(sum(carbs) FILTER (cat IN {_FOOD}),0) AS BIGINT) AS cg
        FROM req
        GROUP BY ALL) r USING (pump, day)
        LEFT
        JOIN (SELECT pump, day, count(*) FILTER (action = 'activated') AS ac
        FROM alarms
        GROUP BY ALL) a USING (pump, day)

        LEFT
        JOIN (SELECT pump, day, avg(p - a) AS pk
        FROM (SELECT r.pump, r.day, r.seqnum, arg_max(c.bg, (c.t, c.seqnum)) FILTER (c.t <= r.t) AS a, max(c.bg) FILTER (c.t >= r.t) AS p
        FROM req r
        JOIN cgm c ON c.pump = r.pump AND c.day = r.day AND c.t BETWEEN r.t - 600 AND r.t + 7200
        WHERE r.cat IN {_FOOD}
        GROUP BY ALL)
        WHERE a IS NOT NULL AND p IS NOT NULL
        GROUP BY ALL) p USING (pump, day)
        LEFT
        JOIN sm USING (pump, day)
        LEFT
        JOIN om USING (pump, day)""", _BAS, _overlap("sus", "s", "e", "sm"), _overlap("gaps", "s", "e", "om")),
    "anchored_windows": _with("SELECT pump AS pump_serial, seqnum, CAST(n AS INTEGER) AS n_samples, round(n/7.0,4)::DOUBLE AS coverage, round(CAST(sum_bg AS DOUBLE),4) AS sum_bg FROM win", _WIN),
    "rise_slopes": _with(f"""SELECT pump AS pump_serial, seqnum, {_T('ts')} AS anchor_ts, {_T('ts - INTERVAL 60 MINUTE')} AS rise_start_ts,
        CAST(n AS INTEGER) AS n_samples, round(coverage,4) AS coverage, v0 AS start_level, v1 AS end_level, v1 - v0 AS delta,
        round(slope,4) AS slope, h AS hour_of_day, mult AS multiplier
        FROM ris""", _WIN),
    "meal_rises": _with(f"SELECT pump AS pump_serial, seqnum, {_T('ts')} AS anchor_ts, v0 AS start_level, v1 AS end_level, v1 - v0 AS delta, h AS hour_of_day, vals AS \"values\" FROM det", _WIN),
    "meal_rises_without_gaps": _with("SELECT pump AS pump_serial, seqnum FROM det d WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE g.pump = d.pump AND g.s <= d.ts AND coalesce(g.e, g.s + INTERVAL 12 HOUR) >= d.ts - INTERVAL 60 MINUTE)", _WIN),
    "meal_rise_instances": _with(f"SELECT pump AS pump_serial, seqnum, {_T('ts')} AS anchor_ts, strftime(l, '%Y-%m-%dT%H:%M') || '-08:00' AS event_ref FROM inst", _WIN + _THIN, recursive=True),
    "meal_rise_scored": _with(f"""SELECT pump AS pump_serial, seqnum, {_T('ts')} AS anchor_ts, {_T('ts - INTERVAL 60 MINUTE')} AS rise_start_ts, v0 AS start_level,
        v1 AS end_level, v1 - v0 AS delta, h AS hour_of_day, label, fcat AS matched_bolus_category, carbs AS matched_bolus_carbs,
        round((ft - (t-3600))/60,4) AS bolus_delay_min, resolution, round(CASE WHEN ft IS NULL THEN (xt - (t-3600))/60 END,4) AS resolution_delay_min
        FROM sc""", _WIN + _THIN + _SCORE, recursive=True),
    "meal_rise_summary": _with("""
        SELECT count(*) AS total, count(*) FILTER (label = 'pre_bolused') AS pre_bolused,
        count(*) FILTER (label = 'late_bolused') AS late_bolused, count(*) FILTER (label = 'uncovered') AS uncovered,
            count(*) FILTER (resolution = 'auto_correction') AS resolved_auto_correction,
        count(*) FILTER (resolution = 'user_correction') AS resolved_user_correction, count(*) FILTER (resolution = 'none') AS resolved_none,
            round(coalesce(count(*) FILTER (label = 'uncovered') / nullif(count(*), 0), 0), 4) AS uncovered_rate
        FROM sc""", _WIN + _THIN + _SCORE, recursive=True),
    "meal_rise_by_hour": _with("SELECT h AS hour_of_day, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in ("late_bolused", "pre_bolused", "uncovered")) + " FROM sc GROUP BY h", _WIN + _THIN + _SCORE, recursive=True),
    "slope_sweep": _with("""
        SELECT f.base, f.firings, i.instances, i.pre_bolused, i.late_bolused, i.uncovered, round(i.uncovered / i.instances, 4) AS uncovered_rate
        FROM (SELECT base, count(*) AS firings FROM sw GROUP BY base) f
        JOIN (
            SELECT base, count(*) AS instances, count(*) FILTER (ft IS NOT NULL AND ft < t - 3600) AS pre_bolused,
        count(*) FILTER (ft >= t - 3600) AS late_bolused, count(*) FILTER (ft IS NULL) AS uncovered
            FROM sw1 GROUP BY base
        ) i USING (base)""",
        _WIN, "sw AS (SELECT b.base, ris.* FROM ris JOIN (VALUES (1.0::DOUBLE),(1.4::DOUBLE),(1.8::DOUBLE),(2.2::DOUBLE)) b(base) ON slope >= base*mult)",
        "sw0 AS (SELECT base, pump, min(t) AS t FROM sw GROUP BY ALL UNION ALL SELECT i.base, i.pump, (SELECT min(s.t) FROM sw s WHERE s.base = i.base AND s.pump = i.pump AND s.t >= i.t + 3600) FROM sw0 i WHERE i.t IS NOT NULL)",
        f"""sw1 AS (
            SELECT sw.base, sw.t, (
                SELECT arg_min(r.t, (abs(r.t - (sw.t - 3600)), r.t, r.seqnum)) FROM req r
                WHERE r.pump = sw.pump AND r.cat IN {_FOOD} AND r.t BETWEEN sw.t - 3600 - 1800 AND sw.t - 3600 + 2700
            ) AS ft
            FROM sw JOIN (SELECT DISTINCT * FROM sw0 WHERE t IS NOT NULL) k ON k.base = sw.base AND k.pump = sw.pump AND k.t = sw.t
        )""", recursive=True),
    "anomaly_crossings": _with(f"""SELECT pump AS pump_serial, seqnum, {_T('ts')} AS timestamp, CASE WHEN bg > 180 AND b <= 180 THEN 'spike' ELSE 'drop' END AS anomaly_type,
        bg AS bg_at_event, round((bg - b)/mi,4) AS rate_mgdl_per_min, round(least(1.0,
        CASE WHEN bg > 180 AND b <= 180 THEN (bg-180)/180.0 ELSE (70-bg)/70.0 END)::DOUBLE,4) AS confidence, backfilled AS is_backfilled_context
        FROM (SELECT *, lag(bg) OVER w AS b, (t - lag(t) OVER w)/60.0::DOUBLE AS mi
        FROM cgm
        WINDOW w AS (PARTITION BY pump ORDER BY ts, seqnum))
        WHERE mi > 0 AND ((bg > 180 AND b <= 180) OR (bg < 70 AND b >= 70))"""),
    "anomaly_flatlines": _with(f"""SELECT f2.pump AS pump_serial, seqnum, {_T('ts')} AS timestamp, 'flatline' AS anomaly_type, bg AS bg_at_event,
        0.0::DOUBLE AS rate_mgdl_per_min, round(greatest(0.0, 1 - va/60),4)::DOUBLE AS confidence, backfilled AS is_backfilled_context
        FROM f2
        JOIN (SELECT DISTINCT *
        FROM f3
        WHERE r IS NOT NULL) k ON k.pump = f2.pump AND k.r = f2.r""",
        "f1 AS (SELECT *, row_number() OVER w AS r, CASE WHEN count(bg) OVER w3 = 3 THEN var_samp(bg) OVER w3 END AS va, (t - lag(t) OVER w)/60.0::DOUBLE AS g FROM cgm WINDOW w AS (PARTITION BY pump ORDER BY ts, seqnum), w3 AS (PARTITION BY pump ORDER BY ts, seqnum ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))", "f2 AS (SELECT * FROM (SELECT *, max(g) OVER (PARTITION BY pump ORDER BY ts, seqnum ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS mg FROM f1) WHERE va < 60 AND mg <= 30)",
        "f3 AS (SELECT pump, min(r) AS r FROM f2 GROUP BY pump UNION ALL SELECT i.pump, (SELECT min(x.r) FROM f2 x WHERE x.pump = i.pump AND x.r >= i.r + 3) FROM f3 i WHERE i.r IS NOT NULL)", recursive=True),
    "meal_runs": _with(f"""SELECT m.pump AS pump_serial, m.seqnum, {_T('m.ts')} AS timestamp, b AS bg_start, pk AS bg_peak, round(rate,4) AS rise_rate_per_5min,
        lab AS meal_window, round(least(1.0, least(1.0,
        rate/8.0) + CASE WHEN lab <> 'off_window' THEN 0.1 ELSE 0 END + CASE WHEN pk > 180 THEN 0.1 ELSE 0 END)::DOUBLE,4) AS confidence

        FROM (SELECT m1.*,
        CASE WHEN hour(ts) >= 6 AND hour(ts) < 10 THEN 'window_0' WHEN hour(ts) >= 11 AND hour(ts) < 14 THEN 'window_1' WHEN hour(ts) >= 17 AND hour(ts) < 23 THEN 'window_2' ELSE 'off_window' END AS lab, (SELECT max(c.bg)
        FROM cgm c
        WHERE c.pump = m1.pump AND c.t BETWEEN m1.t AND m1.t + 7200) AS pk
        FROM m1
        JOIN (SELECT DISTINCT *
        FROM m2
        WHERE r IS NOT NULL) k ON k.pump = m1.pump AND k.r = m1.r) m
 WHERE NOT EXISTS (SELECT 1 FROM req q WHERE q.pump = m.pump AND q.cat IN {_FOOD} AND q.t BETWEEN m.t - 1800 AND m.t)""",
        "m0 AS (SELECT *, row_number() OVER w AS r, lag(bg) OVER w AS b, bg - lag(bg) OVER w AS rise, coalesce((t - lag(t) OVER w)/60.0 BETWEEN 0.5 AND 30 AND bg - lag(bg) OVER w >= 4, false) AS ok FROM cgm WINDOW w AS (PARTITION BY pump ORDER BY ts, seqnum))", "m1 AS (SELECT * FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS run, avg(rise) OVER w AS rate FROM m0 WINDOW w AS (PARTITION BY pump ORDER BY ts, seqnum ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) WHERE run = 2)",
        "m2 AS (SELECT pump, min(r) AS r FROM m1 GROUP BY pump UNION ALL SELECT i.pump, (SELECT min(x.r) FROM m1 x WHERE x.pump = i.pump AND x.r >= i.r + 2) FROM m2 i WHERE i.r IS NOT NULL)", recursive=True),
    "cgm_dates": _with("SELECT DISTINCT CAST(day AS VARCHAR) AS day FROM cgm"),
    "date_bounds": _with("SELECT CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS anchor_day FROM cgm"),
    "table_extents": _with(" UNION ALL ".join(f"SELECT '{n}' AS name, {_T(f'min({t})')} AS first_ts, {_T(f'max({t})')} AS last_ts, count(*) AS n FROM {src}" for n, t, src in (("cgm", "ts", "cgm"), ("bolus", "ts", "bolus"), ("basal", "ts", "basal"), ("alarms", "ts", "alarms"), ("suspension", "s", "sus"), ("cgm_gaps", "s", "gaps")))),
    "category_counts": _with("SELECT cat AS bolus_category, count(*) AS n FROM req GROUP BY cat"),
    "same_second_stacking": _with(f"SELECT {_T('b')} AS bucket, count(*) AS n FROM (SELECT date_trunc('second', ts) AS b FROM cgm) GROUP BY b HAVING count(*) >= 2"),
    "pump_is_single": _with("SELECT backfilled, CASE WHEN count(DISTINCT pump) = 1 THEN min(pump) END AS pump_serial, count(DISTINCT pump) AS n_pumps FROM cgm GROUP BY backfilled"),
    "bounded_scan": _with(f"""SELECT pump AS pump_serial, seqnum, {_T('ts')} AS timestamp, bg AS bg_mgdl, backfilled
        FROM cgm
        WHERE pump = '0' AND ts >= TIMESTAMP '2024-01-09 08:00:00' AND ts < TIMESTAMP '2024-01-11 08:00:00'"""),
    "upsert_result": _with(f"SELECT pump AS pump_serial, seqnum, {_T('ts')} AS timestamp, CASE WHEN backfilled THEN 1 ELSE bg END AS bg_mgdl, backfilled FROM cgm"),
    "live_latest": _with(f"SELECT pump AS pump_serial, seqnum, {_T('ts')} AS timestamp, bg AS bg_mgdl FROM cgm QUALIFY row_number() OVER (PARTITION BY pump ORDER BY ts DESC, seqnum DESC) <= 12"),
    "delete_range_result": _with("SELECT pump AS pump_serial, count(*) AS n, max(seqnum) AS last FROM cgm WHERE NOT (ts >= TIMESTAMP '2024-01-10 08:00:00' AND ts < TIMESTAMP '2024-01-11 08:00:00' AND pump = '0') GROUP BY pump"),
    "alerts_page": _with(f"""SELECT seqnum AS id, {_T('ts')} AS fired_at, pump AS pump_serial, name AS alert_kind, count(*) OVER () AS total
        FROM alarms
        WHERE action = 'activated'
        ORDER BY ts DESC, seqnum DESC LIMIT 10 OFFSET 20"""),
    "alert_retries": _with(f"""SELECT ref AS event_ref, count(*) AS attempts, bool_or(action = 'ack') AS delivered, {_T('max(ts)')} AS last_ts,
        NOT bool_or(action = 'ack') AND count(*) < 3 AS retry
        FROM (SELECT *, name || ':' || pump || ':' || strftime(ts, '%Y-%m-%d') AS ref
        FROM alarms)
        GROUP BY ref"""),
    "day_chart": _with(f"""
        SELECT pump AS pump_serial, 'cgm' AS layer, CAST(hour(l)*60 + minute(l) AS INTEGER) AS minute, NULL::INTEGER AS until_minute,
        bg::DOUBLE AS value, backfilled
        FROM cgm
        WHERE day = DATE '2024-01-10'
       
        UNION ALL SELECT pump, 'bolus', CAST(hour({_LOCAL('ts')})*60 + minute({_LOCAL('ts')}) AS INTEGER), NULL, round(units, 4), NULL
        FROM bolus
        WHERE day = DATE '2024-01-10'
       
        UNION ALL SELECT pump, 'basal', CAST(hour({_LOCAL('ts')})*60 + minute({_LOCAL('ts')}) AS INTEGER), NULL, round(rate, 4), NULL
        FROM basal
        WHERE day = DATE '2024-01-10'
       
        UNION ALL SELECT pump, layer, CAST(hour({_LOCAL('x1')})*60 + minute({_LOCAL('x1')}) AS INTEGER),
        CAST(hour({_LOCAL('x2')})*60 + minute({_LOCAL('x2')}) AS INTEGER), NULL, NULL
        FROM laid
        WHERE x1 < x2""",
        *_OC,
        "lo AS (SELECT TIMESTAMP '2024-01-10 08:00:00' AS a, TIMESTAMP '2024-01-11 08:00:00' AS b)",
        "areas AS (SELECT pump, layer, greatest(s, a) AS s, least(e, b) AS e FROM (SELECT pump, 'gap' AS layer, s, coalesce(e, TIMESTAMP '2024-01-11 08:00:00') AS e FROM gaps UNION ALL SELECT pump, 'site_issue', f, g FROM oc), lo)",
        """laid AS (
            SELECT x.pump, layer, coalesce((SELECT max(c.ts)
        FROM cgm c
        WHERE c.pump = x.pump AND c.day = DATE '2024-01-10' AND c.ts <= x.s), (SELECT min(c.ts)
        FROM cgm c
        WHERE c.pump = x.pump AND c.day = DATE '2024-01-10')) AS x1,
                coalesce((SELECT min(c.ts)
        FROM cgm c
        WHERE c.pump = x.pump AND c.day = DATE '2024-01-10' AND c.ts >= x.e), (SELECT max(c.ts)
        FROM cgm c
        WHERE c.pump = x.pump AND c.day = DATE '2024-01-10')) AS x2
            FROM areas x WHERE s < e
        )"""),
    "trends_digest": _with("""
        SELECT string_agg(days || '-day: ' || coalesce(CAST(round_even(tir, 0) AS INTEGER) || ' %', '—'), chr(10) ORDER BY days) AS digest
       
        FROM (SELECT d AS days, 100.0*count(*) FILTER (bg BETWEEN 70 AND 180)/nullif(count(bg),0) AS tir
        FROM (VALUES (7),(14),(30)) w(d)
        JOIN cgm ON ts < TIMESTAMP '2024-01-31 08:00:00' AND ts >= TIMESTAMP '2024-01-31 08:00:00' - to_days(d)
        GROUP BY d)"""),
    "day_sanity": _with(f"""
        SELECT pump AS pump_serial, readings, mean_bg, min_bg, max_bg, tir_percent, coverage_percent, boluses, round(bolus_units,
        4) AS bolus_units, requests, meals, carbs_g,
            basal_entries, round(u + 1e-9, 4) AS basal_units, basal_sources, suspensions, suspect_suspensions, suspended_minutes,
        mode_changes, site_changes, alarms_activated, alarm_rows, round(bolus_units + u + 1e-9, 4) AS total_units
        FROM (
            SELECT pump, count(*) AS readings, round(avg(bg), 4) AS mean_bg, min(bg) AS min_bg, max(bg) AS max_bg, {_TIR} AS tir_percent,
        round(100.0*count(*)/288, 4)::DOUBLE AS coverage_percent
            FROM cgm WHERE day = DATE '2024-01-10' GROUP BY pump
        ) c
        FULL JOIN (SELECT pump, count(*) AS boluses, {_UNITS} AS bolus_units FROM bolus WHERE day = DATE '2024-01-10' GROUP BY pump) b USING (pump)
       
        FULL
        JOIN (SELECT pump, count(*) AS requests, count(*) FILTER (carbs > 0) AS meals, CAST(sum(carbs) FILTER (carbs > 0) AS BIGINT) AS carbs_g
        FROM req
        WHERE day = DATE '2024-01-10'
        GROUP BY pump) r USING (pump)
        FULL JOIN (SELECT pump, count(*) AS basal_entries, {_ROUGH} AS u FROM basal WHERE day = DATE '2024-01-10' GROUP BY pump) u USING (pump)
        FULL JOIN (
            SELECT pump, string_agg(src || ':' || n, ',' ORDER BY src || ':' || n) AS basal_sources
            FROM (SELECT pump, {_SOURCE} AS src, count(*) AS n FROM basal WHERE day = DATE '2024-01-10' GROUP BY ALL) GROUP BY pump
        ) x USING (pump)
        FULL JOIN (
            SELECT pump, count(*) AS suspensions, count(*) FILTER (coalesce(eo OR mins > 1440, false)) AS suspect_suspensions,
        CAST(sum(floor(mins)) AS BIGINT) AS suspended_minutes
            FROM sus WHERE {_DAY('s')} = DATE '2024-01-10' GROUP BY pump
        ) s USING (pump)
        FULL JOIN (
            SELECT pump, count(*) FILTER (et = 'purchase') AS mode_changes, count(*) FILTER (et = 'signup') AS site_changes
            FROM ev WHERE {_DAY('ts')} = DATE '2024-01-10' AND (et = 'signup' OR et = 'purchase' AND k % 5 = 0) GROUP BY pump
        ) e USING (pump)
       
        FULL
        JOIN (SELECT pump, count(*) FILTER (action = 'activated') AS alarms_activated, count(*) AS alarm_rows
        FROM alarms
        WHERE day = DATE '2024-01-10'
        GROUP BY pump) a USING (pump)"""),
    "day_digest": _with(f"""
        SELECT CAST(c.day AS VARCHAR) AS day, tir AS tir_percent, mean_bg, readings, round(coalesce(b, 0), 4) AS bolus_units, coalesce(carbs,
        0) AS carbs_g, coalesce(n, 0) AS alerts
       
        FROM (SELECT day, round(100.0*count(*) FILTER (bg BETWEEN 70 AND 180)/count(bg), 4) AS tir, round(avg(bg), 4) AS mean_bg, count(bg) AS readings
        FROM cgm
        GROUP BY day) c
        LEFT JOIN (SELECT day, {_UNITS} AS b FROM bolus GROUP BY day) USING (day)
        LEFT JOIN (SELECT day, CAST(coalesce(sum(carbs) FILTER (cat IN {_FOOD}), 0) AS BIGINT) AS carbs FROM req GROUP BY day) USING (day)
        LEFT JOIN (SELECT day, count(*) AS n FROM alarms WHERE action = 'activated' GROUP BY day) USING (day)"""),
    "status_signals": _with(f"""
        SELECT label, {_T('at_')} AS signal_ts,
        CASE WHEN at_ IS NULL THEN 'missing' WHEN label = 'last_alert' THEN CASE detail WHEN 'failed' THEN 'stale' ELSE 'ok' END WHEN {_S("TIMESTAMP '2024-01-31'")} - {_S('at_')} <= hours * 3600 THEN 'ok' ELSE 'stale' END AS freshness, detail
        FROM (
            SELECT 'cgm_data' AS label, max(ts) AS at_, 26.0 AS hours, NULL AS detail FROM cgm
            UNION ALL SELECT 'live_loop', max(ts), 0.25, NULL FROM ev WHERE et = 'click'
            UNION ALL SELECT 'sync:' || pump, max(ts), 26.0, 'pump' FROM ev GROUP BY pump
            UNION ALL SELECT 'last_detection', max(ts), 24.0, NULL FROM ev WHERE et = 'view'
           
        UNION ALL SELECT 'last_alert', max(ts), NULL, arg_max(CASE WHEN k % 2 = 0 THEN 'sent' WHEN k % 5 = 0 THEN 'failed' ELSE 'pending' END, (ts, seqnum))
        FROM alarms
        WHERE action = 'activated'
        )"""),
    "rate_source_counts": _with(f"SELECT {_SOURCE} AS rate_source, count(*) AS n FROM basal GROUP BY 1"),
}

_ROUTED = f"""
cgmt AS (SELECT * FROM (SELECT *, lag(ts) OVER (PARTITION BY pump ORDER BY ts, seqnum) AS b FROM cgm)
  WHERE b IS NULL OR backfilled OR epoch_us(ts) - epoch_us(b) >= 60000000),
bas1 AS (SELECT * FROM basal QUALIFY row_number() OVER (PARTITION BY pump, ts ORDER BY seqnum) = 1),
issue AS (
  SELECT oc.*, (SELECT min(x.ts) FROM forced x WHERE x.pump = oc.pump AND x.ts > oc.g AND NOT x.forced) AS r FROM oc)"""
_TABLES = {
    "cgm": ("cgmt", "ts", "sum(bg)", None), "bolus": ("bolus", "ts", "sum(seqnum)", None), "requests": ("req", "ts", "sum(length(cat) * (seqnum % 7 + 1))", None), "basal": ("bas1", "ts", "sum(milli)", None),
    "suspension": ("sus", "s", "sum(floor(mins))", "e"), "events": ("forced", "ts", "count(*) FILTER (forced)", None), "alarms": ("alarms", "ts", "sum(length(name) * (seqnum % 7 + 1))", None),
    "site_issues": ("issue", "f", "sum(n * 1000 + coalesce(floor((epoch_us(r) - epoch_us(g))/60e6), 0))", "r"), "cgm_gaps": ("gaps", "s", "sum(floor((epoch_us(e) - epoch_us(s))/60e6))", "e"),
}
_EXTENT = " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS n, {_T(f'min({t})')} AS first_ts, {_T(f'max({t})')} AS last_ts, CAST({total} AS BIGINT) AS total, {f'count({end})' if end else 'NULL::BIGINT'} AS ended FROM {source}"
    for n, (source, t, total, end) in _TABLES.items()
)
_ROUTER = _with(_EXTENT, *_OC, _ROUTED)
_REFS = "refs AS (SELECT *, name || ':' || pump || ':' || strftime(day, '%Y-%m-%d') AS ref FROM alarms)"

ORACLE_SQL |= {
    "router_tables": _ROUTER,
    # Stored suspensions have one row a key: of two in one second the one that the other ends at once.
    "sync_in_steps": _with(_EXTENT.replace("FROM sus ", "FROM sus1 ").replace("FROM sus UNION", "FROM sus1 UNION"), *_OC, _ROUTED, "sus1 AS (SELECT * FROM sus QUALIFY row_number() OVER (PARTITION BY pump, s ORDER BY e NULLS FIRST) = 1)"),
    "router_unhandled": _with("SELECT 'heartbeat' AS event_class, count(*) AS n FROM ev WHERE et = 'view' AND k % 10 = 9"),
    "sync_state": _with(
        f"""
        SELECT 'pump:' || pump AS label, concat_ws(' ', '2024-01-20', strftime(min(ts), '%Y-%m-%d'), strftime(max(ts), '%Y-%m-%d'), strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ')) AS value
        FROM ev WHERE ts < TIMESTAMP '2024-01-20' GROUP BY pump
        UNION ALL SELECT 'version_matches', 'true'
        UNION ALL SELECT 'empty_tables', ''
        UNION ALL SELECT 'stacked_seconds', CAST(count(*) AS VARCHAR) FROM (SELECT ts FROM cgmt WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ts HAVING count(*) >= 3)""",
        *_OC,
        _ROUTED,
    ),
    "alerts_claimed": _with(
        f"""
        SELECT name AS alert_kind, ref AS event_ref, pump AS pump_serial, {_T('min(ts)')} AS fired_at, 'pending' AS delivery
        FROM refs WHERE action = 'activated' AND name = 'OcclusionAlarm' GROUP BY ALL HAVING min(ts) >= TIMESTAMP '2024-01-21'""",
        _REFS,
    ),
    "detection_log": _with(f"""
        SELECT name AS kind, action AS payload, count(*) AS n, {_T('min(ts)')} AS first_ts, {_T('max(ts)')} AS last_ts
        FROM alarms WHERE action IN ('activated', 'cleared') AND name IN ('OcclusionAlarm', 'LowInsulinAlert') GROUP BY ALL"""),
    "retries_due": _with(
        f"""
        SELECT ref AS event_ref, {_T('fired')} AS fired_at, CAST(failures AS INTEGER) AS attempts
        FROM (SELECT ref, min(ts) FILTER (action = 'activated') AS fired, count(*) FILTER (said AND action = 'cleared') AS failures,
            count(*) FILTER (said AND action = 'ack') AS delivered, max(ts) FILTER (said) AS last
          FROM (SELECT *, action = 'cleared' OR action = 'ack' AND name = 'LowInsulinAlert' AS said FROM refs) GROUP BY ref)
        WHERE fired >= TIMESTAMP '2024-01-26' AND delivered = 0 AND failures < 30 AND coalesce(last, fired) <= TIMESTAMP '2024-01-30 14:00:00'""",
        _REFS,
    ),
    "repaired_times": _with(f"""
        SELECT pump AS pump_serial, CAST({_DAY('at_')} AS VARCHAR) AS day, count(*) AS n, CAST(sum(seqnum) AS BIGINT) AS seqnums
        FROM (SELECT *, CASE WHEN pump = '0' AND day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' THEN ts + INTERVAL 7 HOUR ELSE ts END AS at_ FROM cgm)
        GROUP BY ALL"""),
    "enriched_view": _with(
        """
        SELECT cat AS label, count(*) AS n FROM req GROUP BY cat
        UNION ALL SELECT 'forced:' || forced, count(*) FROM forced GROUP BY forced
        UNION ALL SELECT 'ongoing:' || (e IS NULL), count(*) FROM gaps GROUP BY e IS NULL
        UNION ALL SELECT 'site_issues', count(*) FROM oc""",
        *_OC,
    ),
    "bulk_copied": _with("""
        SELECT 'bolus' AS name, count(*) AS received, count(*) FILTER (units <= 1) AS inserted, count(*) FILTER (units > 1) AS skipped, count(*) AS stored FROM bolus
        UNION ALL SELECT 'alarms', count(*), count(*), 0, count(*) FROM alarms"""),
    "pump_list": _with("""
        SELECT pump AS pump_serial, CASE WHEN count(*) FILTER (k % 2 = 0) % 2 = 0 THEN 'x2' ELSE 'unknown' END AS model, strftime(min(ts), '%Y-%m-%d') AS first_day,
          strftime(max(ts), '%Y-%m-%d') AS last_day FROM ev GROUP BY pump"""),
    "report_files": _with("SELECT h AS hour_of_day, label, count(*) AS n FROM sc GROUP BY ALL", _WIN + _THIN + _SCORE, recursive=True),
    "nearest_day": _with("""
        SELECT strftime(arg_min(day, (abs(day - DATE '2024-02-15'), day)), '%Y-%m-%d') AS nearest, CAST(ceil(count(DISTINCT day) / 10.0) AS BIGINT) AS pages FROM cgm"""),
    "status_digest": _with(f"""
        SELECT 'Status' || chr(10) || string_agg(title || ': ' || coalesce(strftime(at_, '%Y-%m-%d %H:%M UTC'), '—') || ' (' || CASE WHEN o = 3 THEN detail ELSE {{age}} END || ')', chr(10) ORDER BY o) AS digest
        FROM (
            SELECT 1 AS o, 'Latest CGM' AS title, max(ts) AS at_, NULL AS detail FROM cgm
            UNION ALL SELECT 2, 'Last detection', max(ts), NULL FROM ev WHERE et = 'view'
            UNION ALL SELECT 3, 'Last alert', max(ts), arg_max(CASE WHEN k % 2 = 0 THEN 'sent' WHEN k % 5 = 0 THEN 'failed' ELSE 'pending' END, (ts, seqnum)) FROM alarms WHERE action = 'activated'
        ), LATERAL (SELECT (epoch(TIMESTAMP '2024-01-31') - epoch(at_)) / 60 AS mins)""".replace("{age}", "CASE WHEN at_ IS NULL THEN 'none recorded' WHEN mins < 0 THEN 'just now' WHEN mins < 90 THEN CAST(round_even(mins, 0) AS INTEGER) || ' min ago' WHEN mins < 2880 THEN CAST(round_even(mins/60, 0) AS INTEGER) || ' h ago' ELSE CAST(round_even(mins/1440, 0) AS INTEGER) || ' d ago' END")),
}


def _clusters(columns: list[str], k: int = 5, rounds: int = 10) -> str:
    """k-means over the rows of daily_features: farthest-first seeds, fixed rounds, as one chain of tables."""
    z = ", ".join(f"(coalesce(f.{c}, s.md_{c}) - s.m_{c}) / CASE WHEN s.s_{c} = 0 THEN 1 ELSE s.s_{c} END" for c in columns)
    medians = ", ".join(f"coalesce(median({c}), 0) AS md_{c}" for c in columns)
    scales = ", ".join(f"avg(coalesce({c}, md_{c})) AS m_{c}, stddev_pop(coalesce({c}, md_{c})) AS s_{c}, any_value(md_{c}) AS md_{c}" for c in columns)
    d = " + ".join(f"(z.x[{i}] - c.c[{i}]) * (z.x[{i}] - c.c[{i}])" for i in range(1, len(columns) + 1))
    steps = [
        f"f AS ({ORACLE_SQL['daily_features']})", f"md AS (SELECT {medians} FROM f)", f"s AS (SELECT {scales} FROM f, md)", f"z AS MATERIALIZED (SELECT pump_serial, day, [{z}] AS x FROM f, s)",
        "seed0 AS (SELECT 0 AS k, x AS c FROM z ORDER BY pump_serial, day LIMIT 1)",
    ]
    for j in range(1, k):
        steps.append(f"seed{j} AS MATERIALIZED (SELECT * FROM seed{j - 1} UNION ALL (SELECT {j}, z.x FROM z, seed{j - 1} c GROUP BY pump_serial, day, z.x ORDER BY min({d}) DESC, pump_serial, day LIMIT 1))")
    before = f"seed{k - 1}"
    for i in range(rounds + 1):
        steps.append(f"near{i} AS MATERIALIZED (SELECT pump_serial, day, z.x, min(struct_pack(d := {d}, k := c.k)) AS m FROM z, {before} c GROUP BY pump_serial, day, z.x)")
        if i < rounds:
            means = ", ".join(f"avg(x[{j}])" for j in range(1, len(columns) + 1))
            steps.append(f"mean{i} AS (SELECT m.k AS k, [{means}] AS c FROM near{i} GROUP BY m.k)")
            steps.append(f"round{i} AS MATERIALIZED (SELECT b.k, coalesce(n.c, b.c) AS c FROM {before} b LEFT JOIN mean{i} n ON n.k = b.k)")
            before = f"round{i}"
    return f"WITH {', '.join(steps)} SELECT pump_serial, day, m.k AS cluster_id, round(sqrt(m.d), 4) AS distance FROM near{rounds}"


ORACLE_SQL["cluster_days"] = _clusters(["mean_bg", "sd_bg", "tir", "tdi", "carbs_g"])
