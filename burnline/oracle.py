"""The same results in DuckDB SQL, written from the definitions, in a chain of common table expressions."""

from __future__ import annotations

K = "account, provider, kind, now_us"

BASE = """
ev AS (SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type AS account,
              CASE WHEN user_id % 2 = 0 THEN 'claude' ELSE 'codex' END AS provider, CAST(floor(value * 100) AS BIGINT) AS t FROM events),
tok AS (SELECT account, provider, CAST(user_id AS VARCHAR) AS request_id, CAST(event_id AS VARCHAR) AS message_id, ts_us, 'm' || (user_id % 3) AS model,
               t // 2 AS input_tokens, t // 4 AS output_tokens, t // 8 AS cache_creation, t - t // 2 - t // 4 - t // 8 AS cache_read, t AS total_tokens FROM ev),
kinds(kind, dur_us, lookback_us, stale_us, dense_us) AS (VALUES ('w5h', 18000000000, 3600000000, 600000000, 3600000000), ('weekly', 604800000000, 21600000000, 10800000000, 86400000000)),
cyc AS (SELECT tok.*, kinds.kind, dur_us, ts_us // dur_us AS cycle FROM tok CROSS JOIN kinds),
lim AS (SELECT account, provider, kind, 0.6::DOUBLE * max(s) AS cap FROM (SELECT account, provider, kind, cycle, sum(total_tokens) AS s FROM cyc GROUP BY ALL) GROUP BY ALL),
smp AS (SELECT account, provider, kind, ts_us,
               least(100.0::DOUBLE, floor(sum(total_tokens) OVER (PARTITION BY account, provider, kind, cycle ORDER BY ts_us) * 100.0::DOUBLE / cap)) AS used,
               CASE WHEN provider = 'codex' THEN (cycle + 1) * dur_us END AS resets_us,
               provider = 'claude' AND CAST(message_id AS BIGINT) % 3 = 0 AS is_estimated
        FROM cyc JOIN lim USING (account, provider, kind))"""

LIVE = """
orig AS (SELECT account, provider, kind, (SELECT max(ts_us) FROM tok) AS now_us, max(ts_us) AS source_us, arg_max(used, ts_us) AS used_now,
                arg_max(coalesce(resets_us, -1), ts_us) AS given FROM smp GROUP BY ALL)"""


def replay(stride: int) -> str:
    return f"""
orig AS (SELECT account, provider, kind, ts_us AS now_us, ts_us AS source_us, used AS used_now, coalesce(resets_us, -1) AS given
         FROM (SELECT *, row_number() OVER (PARTITION BY account, provider, kind ORDER BY ts_us) - 1 AS n FROM smp) WHERE n >= 1 AND (n - 1) % {stride} = 0)"""


ALL = """
orig AS (SELECT account, provider, kind, 9000000000000000000 AS now_us, 0 AS source_us, 0.0 AS used_now, -1 AS given FROM smp GROUP BY ALL)"""

SEGMENTS = f"""
hist AS (SELECT smp.*, orig.now_us FROM smp JOIN orig USING (account, provider, kind) WHERE ts_us <= now_us),
lagged AS (SELECT *, lag(ts_us) OVER w AS prev_ts, lag(used) OVER w AS prev_used, lag(resets_us) OVER w AS prev_resets FROM hist WINDOW w AS (PARTITION BY {K} ORDER BY ts_us)),
flagged AS (SELECT *, coalesce(CASE WHEN provider = 'codex' AND kind = 'weekly' THEN prev_used - used > 5 AND used < 10 AND ts_us >= prev_resets - 1000000
                                    ELSE coalesce(resets_us > prev_resets + 1000000, false) OR (prev_used - used > 5 AND (NOT is_estimated OR used < 10)) END, false) AS is_reset FROM lagged),
seg AS (SELECT *, CAST(sum(CAST(is_reset AS INT)) OVER (PARTITION BY {K} ORDER BY ts_us) AS BIGINT) AS block_id FROM flagged)"""

FACTS = f"""
marked AS (SELECT *, max(block_id) OVER (PARTITION BY {K}) AS last_block, max(CASE WHEN used < 100 THEN ts_us END) OVER (PARTITION BY {K}) AS last_below,
                  row_number() OVER (PARTITION BY {K} ORDER BY ts_us DESC) AS from_end FROM seg),
cur AS (SELECT {K}, count(*) AS n_history, max(last_block) AS last_block, count(*) FILTER (block_id = last_block) AS n_block,
               min(ts_us) FILTER (block_id = last_block) AS block_first, max(ts_us) FILTER (block_id = last_block - 1) AS before_block,
               arg_min(used, ts_us) FILTER (block_id = last_block) AS first_used, arg_max(used, ts_us) AS last_used, max(ts_us) AS last_ts,
               max((prev_ts + ts_us) / 2) FILTER (block_id = last_block AND NOT is_reset AND prev_used = 0 AND used > 0) AS rise_us,
               min(ts_us) FILTER (used >= 100 AND ts_us > coalesce(last_below, -1)) AS saturated_us,
               max(ts_us) FILTER (block_id = last_block AND NOT is_reset AND used < prev_used) AS fall_us,
               arg_max(used, ts_us) FILTER (block_id = last_block AND NOT is_reset AND used < prev_used) AS fall_used
        FROM marked GROUP BY {K}),
fits AS (SELECT {K}, list(struct_pack(t := ts_us, u := used) ORDER BY ts_us) AS rows FROM
            (SELECT m.*, count(*) FILTER (block_id = last_block AND ts_us >= now_us - lookback_us) OVER (PARTITION BY {K}) AS n_recent_rows, lookback_us FROM marked m JOIN kinds USING (kind))
         WHERE block_id = last_block AND CASE WHEN n_recent_rows >= 2 THEN ts_us >= now_us - lookback_us ELSE from_end <= 2 END GROUP BY {K}),
slopes AS (SELECT {K}, len(rows) AS fit_rows, coalesce(list_median(list_filter(list_transform(range(1, len(rows) - greatest(1, len(rows) // 4) + 1),
                 lambda i: CASE WHEN rows[i + greatest(1, len(rows) // 4)].t > rows[i].t
                           THEN (rows[i + greatest(1, len(rows) // 4)].u - rows[i].u) / ((rows[i + greatest(1, len(rows) // 4)].t - rows[i].t) / 3600000000.0::DOUBLE) END),
                 lambda s: s IS NOT NULL)), 0.0) AS slope FROM fits),
blocks AS (SELECT *, CASE WHEN last_block > 0 THEN block_first END AS started_us, CASE WHEN last_block > 0 THEN before_block END AS before_us,
                  CASE WHEN last_block > 0 THEN (before_block + block_first) / 2 END AS boundary_us,
                  CASE WHEN provider = 'codex' AND kind = 'weekly' AND fall_us IS NOT NULL THEN fall_us ELSE block_first END AS span_from,
                  CASE WHEN provider = 'codex' AND kind = 'weekly' AND fall_us IS NOT NULL THEN fall_used ELSE first_used END AS span_used
           FROM cur JOIN orig USING ({K}) JOIN kinds USING (kind) JOIN slopes USING ({K})),
sums AS (SELECT b.account, b.provider, b.kind, b.now_us, count(*) AS n_tokens,
                CAST(sum(total_tokens) FILTER (t.ts_us > span_from AND t.ts_us <= last_ts) AS BIGINT) AS span_tokens,
                CAST(sum(total_tokens) FILTER (t.ts_us >= b.now_us - lookback_us) AS BIGINT) AS recent_tokens, count(*) FILTER (t.ts_us >= b.now_us - lookback_us) AS n_recent,
                CAST(sum(total_tokens) FILTER (t.ts_us >= saturated_us) AS BIGINT) AS over_tokens, count(*) FILTER (t.ts_us >= saturated_us) AS n_over,
                min(t.ts_us) FILTER (t.ts_us >= boundary_us) AS token_after_us,
                sum(input_tokens) FILTER (t.ts_us >= saturated_us) AS over_in, sum(output_tokens) FILTER (t.ts_us >= saturated_us) AS over_out,
                sum(cache_creation) FILTER (t.ts_us >= saturated_us) AS over_new, sum(cache_read) FILTER (t.ts_us >= saturated_us) AS over_read
         FROM blocks b JOIN tok t ON b.account = t.account AND b.provider = t.provider AND t.ts_us <= b.now_us GROUP BY ALL),
anchors AS (SELECT account, provider, now_us, CASE WHEN now_us - a < 18000000000 THEN a END AS anchor_us FROM
              (SELECT o.account, o.provider, o.now_us, list_reduce(list(t.ts_us ORDER BY t.ts_us), lambda a, x: CASE WHEN x - a >= 18000000000 THEN x ELSE a END) AS a
               FROM (SELECT DISTINCT account, provider, now_us FROM orig) o JOIN tok t ON o.account = t.account AND o.provider = t.provider AND t.ts_us <= o.now_us GROUP BY ALL)),
cands AS (SELECT *, CASE WHEN now_us - rise_us < dur_us THEN rise_us END AS rise_ok, boundary_us + dur_us AS base_us
          FROM blocks LEFT JOIN sums USING ({K}) LEFT JOIN anchors USING (account, provider, now_us)),
facts AS (SELECT *, CASE WHEN given >= 0 THEN given::DOUBLE
              WHEN kind = 'w5h' AND coalesce(now_us - boundary_us < dur_us, false)
                THEN list_min(list_filter([CASE WHEN first_used > 0 THEN boundary_us END, token_after_us::DOUBLE, rise_ok], lambda x: x IS NOT NULL)) + dur_us
              WHEN kind = 'w5h' AND (rise_ok IS NOT NULL OR anchor_us IS NOT NULL) THEN least(coalesce(rise_ok, anchor_us::DOUBLE), coalesce(anchor_us::DOUBLE, rise_ok)) + dur_us
              WHEN kind = 'w5h' AND n_tokens IS NOT NULL THEN NULL
              WHEN base_us <= now_us THEN base_us + (floor((now_us - base_us) / dur_us) + 1) * dur_us ELSE base_us END AS resets_us,
            CASE WHEN last_ts > span_from AND last_used < 100 AND last_used - span_used >= 3 AND span_tokens > 0 THEN (last_used - span_used) / span_tokens END AS ratio
          FROM cands),
rates AS (SELECT *, used_now AS used, ratio * coalesce(recent_tokens, 0) / (lookback_us / 3600000000.0::DOUBLE) AS token_rate FROM facts),
live AS (SELECT *, CASE WHEN n_block >= 2 THEN CASE WHEN token_rate > 0 OR (token_rate IS NOT NULL AND slope <= 0) THEN 'tokens' ELSE 'percent' END END AS basis FROM rates),
judged AS (SELECT *, CASE basis WHEN 'tokens' THEN token_rate WHEN 'percent' THEN slope END AS burn, CASE basis WHEN 'tokens' THEN coalesce(n_recent, 0) WHEN 'percent' THEN fit_rows END AS n_rate,
                  now_us - source_us > stale_us AS stale,
                  coalesce(NOT (provider = 'codex' AND kind = 'weekly') AND now_us < resets_us AND source_us >= resets_us - dur_us, false) AS in_cycle FROM live)"""

LINEAR = """
ladder AS (SELECT *, CASE WHEN stale THEN 'IDLE' WHEN started_us IS NOT NULL AND n_block < 2 THEN 'RESET_PENDING' ELSE 'OK' END AS status, coalesce(resets_us, now_us + dur_us) AS horizon_us FROM judged),
paced AS (SELECT *, status = 'OK' AND n_block >= 2 AS projects, CASE WHEN status = 'OK' AND n_block >= 2 AND burn > 0 THEN greatest(0, 100 - used) / burn END AS hours FROM ladder),
lin AS (SELECT *, CASE WHEN now_us + round(hours * 3600000000.0::DOUBLE) < horizon_us THEN now_us + round(hours * 3600000000.0::DOUBLE) END AS eta_us,
               CASE WHEN projects THEN burn ELSE 0.0 END AS burn_per_hour,
               CASE WHEN projects AND (resets_us IS NULL OR resets_us >= now_us + dense_us) THEN least(100.0, greatest(0.0, used + burn * dense_us / 3600000000.0::DOUBLE)) END AS predicted_used,
               CASE WHEN projects AND burn > 0 THEN CASE WHEN n_rate >= 10 THEN 'high' WHEN n_rate >= 3 THEN 'medium' ELSE 'low' END END AS confidence FROM paced)"""

STRIDE = 1


def chain(origins: str, *parts: str, select: str) -> str:
    return "WITH " + ",".join([BASE, origins, *parts]) + "\n" + select


def facts(select: str, origins: str | None = None) -> str:
    return chain(origins or replay(STRIDE), SEGMENTS, FACTS, select=select)


def linear(select: str, origins: str | None = None) -> str:
    return chain(origins or replay(STRIDE), SEGMENTS, FACTS, LINEAR, select=select)


LINEAR_COLUMNS = f"SELECT {K}, used, status, round(burn_per_hour, 6) AS burn_per_hour, round(eta_us / 1e6, 3) AS eta_s, eta_us IS NOT NULL AND resets_us IS NOT NULL AS exhausts, confidence, round(predicted_used, 6) AS predicted_used, round((resets_us - now_us) / 3600000000.0::DOUBLE, 6) AS time_to_reset_h FROM lin"

TRAIL = "sum(total_tokens) OVER (PARTITION BY account, provider ORDER BY ts_us RANGE BETWEEN {n} PRECEDING AND CURRENT ROW)"
W5H, WEEK = 18_000_000_000, 604_800_000_000

#: When the burn of `lin` is used up in working hours, and the moment (w).
WORK = f""", days AS (SELECT {K}, hours, now_us AS from_us, horizon_us, unnest(range(now_us // 86400000000, CAST(floor(horizon_us / 86400000000) AS BIGINT) + 1)) AS day FROM lin WHERE hours IS NOT NULL),
        spans AS (SELECT {K}, hours, horizon_us, greatest(day * 86400000000 + 9 * 3600000000, from_us) AS a, day * 86400000000 + 17 * 3600000000 AS b FROM days WHERE (day + 3) % 7 < 5),
        run AS (SELECT *, sum(b - a) OVER (PARTITION BY {K} ORDER BY a) AS upto, round(hours * 3600000000.0::DOUBLE) AS need FROM spans WHERE b > a),
        hit AS (SELECT {K}, min(b - (upto - need)) AS hit_us FROM run WHERE upto >= need AND need > 0 GROUP BY ALL),
        done AS (SELECT lin.*, CASE WHEN hours <= 0 THEN now_us ELSE hit_us END AS w FROM lin LEFT JOIN hit USING ({K}))"""

SQL: dict[str, str] = {
    "token_events_adapter": f"WITH {BASE} SELECT *, input_tokens + output_tokens + cache_creation + cache_read AS recomputed FROM tok",
    "samples_adapter": f"WITH {BASE} SELECT * FROM smp",
    "cycle_blocks": chain(ALL, SEGMENTS, select="SELECT account, provider, kind, ts_us, used, is_reset, block_id FROM seg"),
    "reset_events": chain(ALL, SEGMENTS, select="SELECT account, provider, kind, ts_us, prev_used, used, round((prev_ts + ts_us) / 2, 6) AS boundary_us FROM seg WHERE is_reset"),
    "current_block": facts(f"SELECT {K}, n_history, n_block, started_us, before_us, round(boundary_us, 6) AS boundary_us FROM judged"),
    "saturation_start": facts(f"SELECT {K}, saturated_us FROM judged WHERE saturated_us IS NOT NULL"),
    "zero_rise_anchor": facts(f"SELECT {K}, round(rise_ok, 6) AS rise_us FROM judged WHERE rise_ok IS NOT NULL"),
    "block_anchor": facts("SELECT DISTINCT account, provider, now_us, anchor_us FROM judged"),
    "sliding_max_tokens": f"WITH {BASE}, a AS (SELECT account, provider, {TRAIL.format(n=W5H)} AS s5, {TRAIL.format(n=WEEK)} AS s7 FROM tok) SELECT account, provider, CAST(max(s5) AS BIGINT) AS max_tokens, 'w5h' AS kind FROM a GROUP BY ALL UNION ALL SELECT account, provider, CAST(max(s7) AS BIGINT), 'weekly' FROM a GROUP BY ALL",
    "trailing_tokens": f"WITH {BASE} SELECT account, provider, message_id, CAST({TRAIL.format(n=W5H)} AS BIGINT) AS trailing FROM tok",
    "limit_estimate": f"""WITH {BASE}, old AS (SELECT *, {TRAIL.format(n=W5H)} AS s5, {TRAIL.format(n=WEEK)} AS s7 FROM tok WHERE ts_us < (SELECT max(ts_us) FROM tok) - 86400000000),
        e AS (SELECT account, provider, max(s5) AS m5, max(s7) AS m7, max(ts_us) - min(ts_us) AS span FROM old GROUP BY ALL), s AS (SELECT DISTINCT account, provider FROM tok)
        SELECT account, provider, 'w5h' AS kind, CASE WHEN span >= 7200000000 THEN CAST(floor(m5 / 0.9::DOUBLE) AS BIGINT) ELSE 88000 END AS limit_tokens, CAST(CASE WHEN account = 'click' THEN 220000 ELSE 88000 END AS BIGINT) AS plan_tokens FROM s LEFT JOIN e USING (account, provider)
        UNION ALL SELECT account, provider, 'weekly', CASE WHEN span >= 86400000000 THEN CAST(floor(m7 / 0.9::DOUBLE) AS BIGINT) END, NULL FROM s LEFT JOIN e USING (account, provider)""",
    "token_windows": chain(LIVE, SEGMENTS, FACTS, select=f"""
        , base AS (SELECT DISTINCT account, provider, now_us, anchor_us, coalesce(anchor_us, now_us) AS start5, now_us - {WEEK} AS start7 FROM judged),
        use AS (SELECT account, provider, 'w5h' AS kind, anchor_us + {W5H} AS resets_us, start5 AS start_us FROM base UNION ALL SELECT account, provider, 'weekly', NULL, start7 FROM base),
        old AS (SELECT tok.account, tok.provider, kind, start_us, ts_us, sum(total_tokens) OVER (PARTITION BY tok.account, tok.provider, kind ORDER BY ts_us RANGE BETWEEN CASE WHEN kind = 'w5h' THEN {W5H} ELSE {WEEK} END PRECEDING AND CURRENT ROW) AS s FROM tok JOIN use USING (account, provider) WHERE ts_us < start_us),
        cap AS (SELECT account, provider, kind, CASE WHEN max(ts_us) - min(ts_us) >= CASE WHEN kind = 'w5h' THEN 7200000000 ELSE 86400000000 END THEN CAST(floor(max(s) / 0.9::DOUBLE) AS BIGINT) WHEN kind = 'w5h' THEN 88000 END AS limit_tokens FROM old GROUP BY account, provider, kind),
        got AS (SELECT account, provider, kind, any_value(resets_us) AS resets_us, max(ts_us) AS source_us, CAST(coalesce(sum(total_tokens) FILTER (ts_us >= start_us), 0) AS BIGINT) AS tokens FROM tok JOIN use USING (account, provider) GROUP BY ALL),
        al AS (SELECT got.*, coalesce(limit_tokens, CASE WHEN kind = 'w5h' THEN 88000 END) AS limit_tokens FROM got LEFT JOIN cap USING (account, provider, kind))
        SELECT account, provider, kind, round(CASE WHEN limit_tokens <= 0 THEN 0.0 ELSE least(100.0, tokens * 100.0::DOUBLE / limit_tokens) END, 6) AS used, resets_us, source_us, tokens, limit_tokens, true AS is_estimated FROM al WHERE limit_tokens IS NOT NULL""").replace("\n\n        ,", ","),
    "derive_resets_at": facts(f"SELECT {K}, round(resets_us, 6) AS resets_us FROM judged"),
    "level_in_cycle": facts("SELECT account, provider, kind, stale, in_cycle FROM judged", LIVE),
    "percent_per_token": facts(f"SELECT {K}, span_from, span_tokens, round(ratio, 12) AS ratio FROM judged"),
    "robust_slope": facts(f"SELECT {K}, CAST(fit_rows AS INT) AS fit_rows, round(slope, 6) AS slope FROM judged"),
    "live_burn": facts(f"SELECT {K}, round(token_rate, 6) AS token_rate, round(burn, 6) AS burn, basis, n_rate FROM judged"),
    "overage_tokens": facts(f"SELECT {K}, CASE WHEN used >= 100 AND saturated_us IS NOT NULL AND n_tokens IS NOT NULL THEN coalesce(over_tokens, 0) END AS over_tokens FROM judged"),
    "overage_cost": facts(f"SELECT {K}, round(CASE WHEN used >= 100 AND saturated_us IS NOT NULL AND n_over > 0 THEN CASE provider WHEN 'claude' THEN (over_in * 3.0::DOUBLE + over_out * 15.0 + over_new * 3.75 + over_read * 0.3) / 1e6 ELSE (over_in * 1.25::DOUBLE + over_out * 10.0) / 1e6 END END, 9) AS cost_usd FROM judged"),
    "burn_forecast_linear": linear(LINEAR_COLUMNS, LIVE),
    "replay_linear": linear(LINEAR_COLUMNS),
    "workhours_eta": linear(f"""{WORK}
        SELECT {K}, round(CASE WHEN w < horizon_us THEN w END / 1e6, 3) AS work_s FROM done"""),
    "no_data_grid": f"""WITH {BASE}, grid AS (SELECT *, unnest(range((SELECT min(ts_us) // 3600000000 FROM tok), (SELECT max(ts_us) // 3600000000 FROM tok) + 1)) AS hour FROM (SELECT DISTINCT account FROM tok) CROSS JOIN (VALUES ('claude'), ('codex')) p(provider) CROSS JOIN (VALUES ('weekly'), ('w5h')) k(kind)),
        seen AS (SELECT account, provider, kind, ts_us // 3600000000 AS hour, arg_max(used, ts_us) AS used, 'OK' AS status FROM smp GROUP BY ALL)
        SELECT account, provider, kind, hour, used, coalesce(status, 'NO_DATA') AS status FROM grid LEFT JOIN seen USING (account, provider, kind, hour)""",
}

HOUR_OF_WEEK = "((({us}) // 86400000000 + 3) % 7) * 24 + (({us}) % 86400000000) // 3600000000"


def profile(source: str) -> str:
    """Pools of the hour-of-week profile of the origins in `source`."""
    return f"""
hourly AS (SELECT a.account, a.provider, a.kind, a.now_us, ratio, t.ts_us // 3600000000 AS slot, sum(total_tokens) AS s FROM {source} a JOIN tok t ON a.account = t.account AND a.provider = t.provider AND t.ts_us <= a.now_us WHERE ratio > 0 GROUP BY ALL),
reach AS (SELECT {K}, min(slot) AS lo, now_us // 3600000000 AS hi, max(ratio) AS ratio FROM hourly GROUP BY {K}),
slots AS (SELECT {K}, ratio, unnest(range(lo, hi)) AS slot FROM reach),
raw AS (SELECT {K}, slot * 3600000000 AS ts_us, r.ratio * coalesce(s, 0) AS v FROM slots r LEFT JOIN (SELECT {K}, slot, s FROM hourly) h USING ({K}, slot)
        UNION ALL SELECT {K}, prev_ts, (seg.used - prev_used) / ((ts_us - prev_ts) / 3600000000.0::DOUBLE) FROM seg JOIN (SELECT {K} FROM {source} WHERE ratio IS NULL OR ratio <= 0) USING ({K}) WHERE NOT is_reset AND ts_us - prev_ts > 0 AND ts_us - prev_ts <= 10800000000),
aged AS (SELECT *, {HOUR_OF_WEEK.format(us="ts_us")} AS bucket, pow(0.5, (now_us - ts_us) / 1814400000000.0::DOUBLE) AS w FROM raw),
pool AS (SELECT *, sum(w) OVER (PARTITION BY {K}, bucket ORDER BY ts_us) AS hi, sum(w) OVER (PARTITION BY {K} ORDER BY ts_us) AS all_hi FROM aged)"""


def scramble(x: str) -> list[str]:
    """Columns x1, x2, x3 that hash the number `x` modulo 2**31 - 1, each from the one before."""
    p = 2**31 - 1
    return [f"({x}) % {p} * 1664525 % {p} AS x1", f"xor(x1, x1 >> 15) * 48271 % {p} AS x2", f"xor(x2, x2 >> 13) * 69621 % {p} AS x3"]


def futures(source: str, runs: int) -> str:
    """Outcomes of the futures of the origins in `source` (with used, live, horizon_h, dense_us)."""
    return f"""
by_bucket AS (SELECT {K}, bucket, list(struct_pack(hi := hi, v := v) ORDER BY ts_us) AS pool FROM pool GROUP BY ALL),
by_all AS (SELECT {K}, list(struct_pack(hi := all_hi, v := v) ORDER BY all_hi) AS all_pool FROM pool GROUP BY ALL),
hours AS (SELECT {K}, used, live_burn, horizon_h, dense_us / 3600000000.0::DOUBLE AS ahead, unnest(range(0, greatest(CAST(ceil(horizon_h) AS BIGINT), 1))) AS i FROM {source} WHERE horizon_h > 0 AND used < 100),
keyed AS (SELECT *, {HOUR_OF_WEEK.format(us="now_us + i * 3600000000")} AS bucket FROM hours),
based AS (SELECT *, (concat('0x', substr(md5(concat_ws(':', '0', account, provider, kind, now_us)), 1, 8)))::BIGINT AS base FROM keyed),
turns AS (SELECT DISTINCT {K}, i, {", ".join(scramble("base + 104729 * i + 1"))} FROM based),
starts AS (SELECT {K}, run, {", ".join(scramble("base + 7919 * run"))} FROM (SELECT DISTINCT {K}, base FROM based) CROSS JOIN range({runs}) r(run)),
grid AS (SELECT k.*, coalesce(pool, all_pool) AS pool, run, (s.x3 + i) * t.x3 % {2**31 - 1} / {2**31 - 1}.0::DOUBLE AS u
         FROM keyed k JOIN turns t USING ({K}, i) JOIN starts s USING ({K}) JOIN by_all USING ({K}) LEFT JOIN by_bucket USING ({K}, bucket)),
drawn AS (SELECT *, greatest(coalesce(list_filter(pool, lambda x: x.hi > u * pool[-1].hi)[1].v, pool[-1].v), 0.0) AS d, pow(0.5, i / 0.5::DOUBLE) AS w FROM grid),
rated AS (SELECT *, CASE WHEN live_burn IS NULL THEN d ELSE w * greatest(live_burn, 0.0) + (1 - w) * d END AS rate, least(1.0, horizon_h - i) AS step FROM drawn),
walked AS (SELECT *, used + coalesce(sum(rate * step) OVER (PARTITION BY {K}, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rated),
runs AS (SELECT {K}, run, coalesce(min(CASE WHEN rate > 0 AND before < 100 AND rate * step >= 100 - before THEN i + (100 - before) / rate END), max(horizon_h)) AS outcome_h,
                CASE WHEN max(ahead) <= max(horizon_h) THEN least(100.0, max(used) + sum(rate * greatest(0.0, least(step, ahead - i)))) END AS level FROM walked GROUP BY {K}, run
         UNION ALL SELECT {K}, run, CASE WHEN used >= 100 AND horizon_h > 0 THEN 0.0 ELSE horizon_h END, CASE WHEN used >= 100 AND dense_us / 3600000000.0::DOUBLE <= horizon_h THEN 100.0 END
         FROM {source} JOIN by_all USING ({K}) CROSS JOIN range({runs}) r(run) WHERE NOT (horizon_h > 0 AND used < 100))"""


def simulated(runs: int) -> list[str]:
    return [
        """
ready AS (SELECT *, CASE WHEN stale AND NOT in_cycle THEN 'IDLE' WHEN started_us IS NOT NULL AND n_block < 2 THEN 'RESET_PENDING' WHEN stale THEN 'IDLE' ELSE 'OK' END AS status,
                 CASE WHEN NOT stale THEN burn END AS live_burn, coalesce((resets_us - now_us) / 3600000000.0::DOUBLE, dur_us / 3600000000.0::DOUBLE) AS horizon_h FROM judged),
able AS (SELECT * FROM ready WHERE NOT (stale AND NOT in_cycle) AND NOT (started_us IS NOT NULL AND n_block < 2))""",
        profile("able"),
        futures("able", runs),
        f"""
seen AS (SELECT {K}, count(*) AS n_observations, sum(v * w) / sum(w) AS mean_burn FROM pool GROUP BY ALL),
ran AS (SELECT {K}, list(outcome_h ORDER BY outcome_h) AS o, avg(level) AS predicted_used FROM runs GROUP BY ALL),
spread AS (SELECT {K}, unnest(range(0, greatest(CAST(floor(horizon_h) AS BIGINT), 1))) AS i FROM able),
covered AS (SELECT {K}, avg(CASE WHEN b.bucket IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage FROM (SELECT *, {HOUR_OF_WEEK.format(us="now_us + i * 3600000000")} AS bucket FROM spread) LEFT JOIN (SELECT DISTINCT {K}, bucket FROM pool) b USING ({K}, bucket) GROUP BY ALL),
met AS (SELECT *, o[least(len(o) // 2, len(o) - 1) + 1] AS x50, o[least(CAST(floor(len(o) * 0.9::DOUBLE) AS BIGINT), len(o) - 1) + 1] AS x90 FROM ready LEFT JOIN seen USING ({K}) LEFT JOIN ran USING ({K}) LEFT JOIN covered USING ({K})),
etas AS (SELECT *, CASE WHEN x50 < horizon_h THEN now_us + round(x50 * 3600000000.0::DOUBLE) END AS at50, CASE WHEN x50 < horizon_h AND x90 < horizon_h THEN now_us + round(x90 * 3600000000.0::DOUBLE) END AS at90, coalesce(resets_us, now_us + dur_us) AS horizon_us,
                CASE WHEN n_observations >= 10 THEN 2 WHEN n_observations >= 3 THEN 1 ELSE 0 END AS r1, CASE WHEN n_rate >= 10 THEN 2 WHEN n_rate >= 3 THEN 1 ELSE 0 END AS r2 FROM met),
ranks AS (SELECT *, CASE WHEN coverage < 0.5 THEN 0 WHEN coverage < 0.8 THEN least(r1, 1) ELSE r1 END AS r3 FROM etas),
sim AS (SELECT *, CASE WHEN at50 < horizon_us THEN at50 END AS eta_us, CASE WHEN at90 < horizon_us THEN at90 END AS p90_us,
               CASE WHEN n_observations IS NOT NULL AND resets_us IS NOT NULL THEN len(list_filter(o, lambda x: x < horizon_h)) / len(o)::DOUBLE END AS risk,
               CASE WHEN n_observations IS NOT NULL THEN ['low', 'medium', 'high'][CASE WHEN live_burn IS NOT NULL THEN least(r3, r2) ELSE r3 END + 1] END AS confidence,
               CASE WHEN n_observations IS NULL THEN 0.0 ELSE coalesce(live_burn, mean_burn) END AS burn_per_hour,
               CASE WHEN n_observations IS NOT NULL THEN CASE WHEN live_burn IS NOT NULL THEN basis WHEN ratio > 0 THEN 'tokens' ELSE 'percent' END END AS burn_basis FROM ranks)""",
    ]


SIM_COLUMNS = f"""SELECT {K}, used, status, round(burn_per_hour, 4) AS burn_per_hour, burn_basis, n_observations, round(eta_us / 1e6, 2) AS eta_s, round(p90_us / 1e6, 2) AS p90_s, round(eta_us / 1e6, 2) AS work_s, round(risk, 6) AS risk,
    round(coverage, 6) AS coverage, confidence, round(predicted_used, 4) AS predicted_used, eta_us IS NOT NULL AND resets_us IS NOT NULL AS exhausts FROM sim"""

# All readings in blocks, with what came after: the truths that forecasts are graded by.
TRUTHS = """
whole AS (SELECT *, lag(ts_us) OVER w AS prev_ts, lag(used) OVER w AS prev_used, lag(resets_us) OVER w AS prev_resets FROM smp WINDOW w AS (PARTITION BY account, provider, kind ORDER BY ts_us)),
marks AS (SELECT *, coalesce(CASE WHEN provider = 'codex' AND kind = 'weekly' THEN prev_used - used > 5 AND used < 10 AND ts_us >= prev_resets - 1000000
                             ELSE coalesce(resets_us > prev_resets + 1000000, false) OR (prev_used - used > 5 AND (NOT is_estimated OR used < 10)) END, false) AS cut FROM whole),
blocked AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY account, provider, kind ORDER BY ts_us) AS block FROM marks),
fated AS (SELECT *, min(CASE WHEN used >= 100 THEN ts_us END) OVER (PARTITION BY account, provider, kind, block ORDER BY ts_us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS full_us,
                 block < max(block) OVER (PARTITION BY account, provider, kind) OR coalesce(max(ts_us) OVER (PARTITION BY account, provider, kind) > resets_us, false) AS over FROM blocked),
graded AS (SELECT *, CASE WHEN used < 100 AND (resets_us IS NULL OR full_us <= resets_us) THEN (full_us - ts_us) / 3600000000.0::DOUBLE END AS realized_h FROM fated),
known AS (SELECT *, CASE WHEN used >= 100 THEN NULL WHEN realized_h IS NOT NULL THEN 1 WHEN over THEN 0 END AS outcome FROM graded)"""


def truth(moments: str) -> str:
    """The level at target_us for (account, provider, kind, made_us, target_us) in `moments`."""
    return f"""
o AS (SELECT m.account, m.provider, m.kind, m.made_us, m.target_us, g.ts_us AS origin_us, g.used AS origin_used, g.resets_us AS origin_resets, g.block AS origin_block FROM {moments} m ASOF LEFT JOIN graded g ON m.account = g.account AND m.provider = g.provider AND m.kind = g.kind AND m.made_us >= g.ts_us),
n AS (SELECT o.*, g.ts_us AS next_us, g.used AS next_used, g.block AS next_block FROM o ASOF LEFT JOIN graded g ON o.account = g.account AND o.provider = g.provider AND o.kind = g.kind AND o.target_us <= g.ts_us),
p AS (SELECT n.*, g.ts_us AS last_us, g.used AS last_used FROM n ASOF LEFT JOIN graded g ON n.account = g.account AND n.provider = g.provider AND n.kind = g.kind AND n.target_us > g.ts_us),
truths AS (SELECT *, CASE WHEN origin_us IS NULL OR target_us < origin_us THEN NULL WHEN target_us = origin_us THEN origin_used WHEN origin_resets IS NOT NULL AND target_us > origin_resets THEN NULL
                     WHEN next_block = origin_block AND next_us > origin_us THEN CASE WHEN next_us = target_us THEN next_used ELSE last_used + (target_us - last_us) / (next_us - last_us)::DOUBLE * (next_used - last_used) END END AS truth FROM p)"""


RUNS = 2000
# The simulating model's 2,000 futures at every reading are too many for SQL: its rival here is the level staying as it is.
STORED = """
stored AS (SELECT account, provider, kind, 'linear' AS model, now_us AS made_us, used, status, burn_per_hour, eta_us, eta_us AS p90_us, CASE WHEN status = 'OK' AND resets_us IS NOT NULL THEN CASE WHEN eta_us IS NOT NULL THEN 0.95 ELSE 0.05 END END AS risk, predicted_used FROM lin
           UNION ALL SELECT account, provider, kind, 'flat', now_us, used, status, 0.0, NULL, NULL, NULL, CASE WHEN predicted_used IS NOT NULL THEN used END FROM lin)"""
DENSE = f"""
moments AS (SELECT account, provider, kind, made_us, any_value(made_us + dense_us) AS target_us, count(predicted_used) AS recorded FROM stored JOIN kinds USING (kind)
            GROUP BY account, provider, kind, made_us HAVING count(*) = 2 AND count(DISTINCT model) = 2 AND count(*) FILTER (status = 'OK' AND used < 100) = 2 AND (count(predicted_used) = 2 OR (count(predicted_used) = 0 AND count(burn_per_hour) = 2))),
{truth("moments").strip()},
errors AS (SELECT kind, model, CASE WHEN recorded > 0 THEN predicted_used ELSE least(100.0, greatest(0.0, used + burn_per_hour * dense_us / 3600000000.0::DOUBLE)) END - truth AS e, origin_used - truth AS pe
           FROM stored JOIN moments USING (account, provider, kind, made_us) JOIN truths USING (account, provider, kind, made_us) JOIN kinds USING (kind) WHERE truth IS NOT NULL),
dense AS (SELECT kind, model, count(*) AS moments, avg(abs(e)) AS mae, avg(e) AS bias, avg(abs(pe)) AS persistence_mae FROM errors GROUP BY ALL),
pooled AS (SELECT model, CAST(sum(moments) AS BIGINT) AS moments, sum(mae * moments) / sum(moments) AS mae, sum(bias * moments) / sum(moments) AS bias, sum(persistence_mae * moments) / sum(moments) AS persistence_mae FROM dense GROUP BY model)"""
RECORDED = DENSE.replace("(count(predicted_used) = 2 OR (count(predicted_used) = 0 AND count(burn_per_hour) = 2))", "count(predicted_used) = 2")
BY_SERIES = RECORDED.replace("errors AS (SELECT kind, model,", "errors AS (SELECT account, provider, kind, model,")
REPORT = """
head AS (SELECT account, provider, kind, count(*) AS readings, (max(ts_us) - min(ts_us)) / 3600000000.0::DOUBLE AS span_h, max(block) + 1 AS blocks FROM blocked GROUP BY ALL HAVING count(*) >= 3),
told AS (SELECT s.*, k.realized_h, CASE WHEN s.risk IS NOT NULL THEN k.outcome END AS outcome, (s.eta_us - s.made_us) / 3600000000.0::DOUBLE - k.realized_h AS late,
                CASE WHEN s.eta_us IS NOT NULL AND s.p90_us IS NOT NULL THEN CAST(k.realized_h <= (s.p90_us - s.made_us) / 3600000000.0::DOUBLE AS INT) END AS held
         FROM stored s JOIN known k ON s.account = k.account AND s.provider = k.provider AND s.kind = k.kind AND s.made_us = k.ts_us),
models AS (SELECT account, provider, kind, model, count(*) AS moments, count(eta_us) AS with_eta, count(eta_us) / count(*)::DOUBLE AS coverage, count(late) AS scored, avg(abs(late)) AS mae_h, avg(late) AS bias_h, count(held) AS p90_checked, avg(held) AS p90_held,
                  count(outcome) AS risk_n, avg(CASE WHEN outcome IS NOT NULL THEN pow(risk - outcome, 2) END) AS brier, avg(outcome) AS base_rate FROM told GROUP BY ALL),
points AS (SELECT account, provider, kind, model, count(*) AS dense_moments, avg(abs(e)) AS dense_mae, avg(e) AS dense_bias FROM (SELECT account, provider, kind, model, e FROM errors UNION ALL SELECT account, provider, kind, 'persistence', pe FROM errors WHERE model = 'linear') GROUP BY ALL),
report AS (SELECT account, provider, kind, model, readings, round(span_h, 4) AS span_h, CAST(blocks AS BIGINT) AS blocks, (SELECT count(*) FROM tok t WHERE t.account = h.account AND t.provider = h.provider) AS events, coalesce(moments, 0) AS moments, coalesce(with_eta, 0) AS with_eta, round(coverage, 4) AS coverage,
                  coalesce(scored, 0) AS scored, round(mae_h, 4) AS mae_h, round(bias_h, 4) AS bias_h, coalesce(p90_checked, 0) AS p90_checked, round(p90_held, 4) AS p90_held, coalesce(risk_n, 0) AS risk_n, round(brier, 4) AS brier, round(base_rate, 4) AS base_rate, round(base_rate * (1 - base_rate), 4) AS base_brier,
                  coalesce(dense_moments, 0) AS dense_moments, round(dense_mae, 4) AS dense_mae, round(dense_bias, 4) AS dense_bias
           FROM head h JOIN (SELECT * FROM models FULL JOIN points USING (account, provider, kind, model)) USING (account, provider, kind))"""
CLAIMS = """
claims AS (SELECT c.*, g.outcome, g.ts_us + g.realized_h * 3600000000.0::DOUBLE AS exhausted_us FROM (SELECT * FROM stored WHERE model = 'linear' AND risk IS NOT NULL) c ASOF LEFT JOIN known g ON c.account = g.account AND c.provider = g.provider AND c.kind = g.kind AND c.made_us >= g.ts_us)"""


def graded(select: str, *more: str) -> str:
    return chain(replay(STRIDE), SEGMENTS, FACTS, LINEAR, TRUTHS, STORED, *more, select=select)


def folded(origins: str, parts: list[str], inputs: str, first: str, step: str, select: str) -> str:
    """A fold in time order: `inputs` has key, n from 1; `step` makes the next state from state f and input i."""
    return "WITH RECURSIVE " + ",".join([BASE, origins, *parts]) + f""", inputs AS ({inputs}),
        fold AS (SELECT DISTINCT key, 0::BIGINT AS n, {first} FROM inputs UNION ALL SELECT f.key, i.n, {step} FROM fold f JOIN inputs i ON f.key = i.key AND i.n = f.n + 1)
        {select}"""


READY = "(f.armed OR i.cleared OR (NOT i.rolling AND coalesce(i.resets_us > f.at_us + 1000000, false)))"
FIRED = folded(
    replay(1),
    [SEGMENTS, FACTS, LINEAR],
    """SELECT *, row_number() OVER (PARTITION BY key ORDER BY now_us) AS n FROM (
        SELECT concat_ws('|', account, provider, kind, 'threshold') AS key, account, provider, kind, 'threshold' AS alert, now_us, used, resets_us, provider = 'codex' AND kind = 'weekly' AS rolling, used >= 90 AS cond, used < 80 AS cleared FROM lin WHERE status <> 'IDLE' OR in_cycle
        UNION ALL SELECT concat_ws('|', account, provider, kind, 'burn'), account, provider, kind, 'burn', now_us, used, resets_us, provider = 'codex' AND kind = 'weekly',
            coalesce(status = 'OK' AND eta_us IS NOT NULL AND resets_us IS NOT NULL AND used >= 25 AND (eta_us - now_us) / 3600000000.0::DOUBLE <= 1, false), provider = 'codex' AND kind = 'weekly' AND used < 25 FROM lin WHERE status <> 'IDLE' OR in_cycle)""",
    "true AS armed, NULL::DOUBLE AS at_us, false AS fired",
    f"{READY} AND NOT i.cond, CASE WHEN {READY} AND i.cond THEN i.resets_us ELSE f.at_us END, {READY} AND i.cond",
    ", fired AS (SELECT account, provider, kind, alert, now_us AS fired_us, used FROM fold JOIN inputs USING (key, n) WHERE fired)",
)
ALERTS = FIRED + " SELECT * FROM fired"
WINS = """CASE WHEN x.resets_us IS NOT NULL AND s.resets_us IS NOT NULL AND abs(x.resets_us - s.resets_us) > 60000000 THEN x.resets_us > s.resets_us WHEN (x.resets_us IS NULL) <> (s.resets_us IS NULL) THEN x.resets_us IS NOT NULL ELSE x.ts_us > s.ts_us END"""
TRIED = "i.ts_us >= f.next_us"
WAIT = "CASE WHEN i.ok THEN 180 ELSE least(f.wait_s * 2, 1800) END"
GOOD = f"CASE WHEN {TRIED} AND i.ok THEN i.ts_us ELSE f.good END"
DAY0 = 1_704_067_200_000_000

SQL |= {
    "realized_exhaustion": f"WITH {BASE}, {TRUTHS} SELECT account, provider, kind, ts_us, round(realized_h, 6) AS realized_h FROM known",
    "risk_outcomes": f"WITH {BASE}, {TRUTHS} SELECT account, provider, kind, ts_us, outcome FROM known",
    "used_at_horizon": chain(replay(1), TRUTHS, "\nm0 AS (SELECT account, provider, kind, now_us + 60000000 AS made_us, now_us + 60000000 + dense_us AS target_us FROM orig JOIN kinds USING (kind))", truth("m0"), select="SELECT account, provider, kind, made_us, origin_us, round(truth, 6) AS truth FROM truths"),
    "dense_score_linear": graded("SELECT kind, model, moments, round(mae, 4) AS mae, round(bias, 4) AS bias, round(persistence_mae, 4) AS persistence_mae FROM dense", DENSE),
    "merged_score_linear": graded("SELECT kind, model, moments, round(mae, 4) AS mae, round(bias, 4) AS bias, round(persistence_mae, 4) AS persistence_mae FROM dense", DENSE),
    "dense_score_recorded": graded("SELECT kind, model, moments, round(mae, 4) AS mae, round(bias, 4) AS bias, round(persistence_mae, 4) AS persistence_mae FROM dense", RECORDED),
    "pool_score_linear": graded("SELECT model, moments, round(mae, 4) AS mae, round(bias, 4) AS bias, round(persistence_mae, 4) AS persistence_mae FROM pooled", DENSE),
    "better_model_linear": graded("""SELECT CASE WHEN reason = 'passes every gate' AND vetoed_by IS NULL THEN challenger ELSE 'linear' END AS chosen, challenger, CASE WHEN reason = 'passes every gate' AND vetoed_by IS NOT NULL THEN 'worse on a window kind' ELSE reason END AS reason, vetoed_by, round(gain, 4) AS gain, round(over_persistence, 4) AS over_persistence FROM (
        SELECT *, CASE WHEN challenger IS NULL THEN 'no challenger has a score' WHEN moments < 500 THEN 'too few moments' WHEN base_mae IS NULL THEN 'the default has no score' WHEN base_mae = 0 THEN 'the default is exact' WHEN gain < 0.15 THEN 'gain over the default is under the margin'
            WHEN p IS NULL THEN 'no persistence score' WHEN p = 0 THEN 'persistence is exact' WHEN over_persistence < 0.15 THEN 'gain over persistence is under the margin' ELSE 'passes every gate' END AS reason FROM (
        SELECT max(model) FILTER (model = 'flat') AS challenger, max(moments) FILTER (model = 'flat') AS moments, max(mae) FILTER (model = 'linear') AS base_mae, max(persistence_mae) FILTER (model = 'flat') AS p,
            (base_mae - max(mae) FILTER (model = 'flat')) / nullif(base_mae, 0) AS gain, (p - max(mae) FILTER (model = 'flat')) / nullif(p, 0) AS over_persistence FROM pooled))
        CROSS JOIN (SELECT arg_max(kind, worse) AS vetoed_by FROM (SELECT a.kind, (a.mae - b.mae) / b.mae AS worse FROM dense a JOIN dense b USING (kind) WHERE a.model = 'flat' AND b.model = 'linear' AND a.moments >= 500 AND b.mae <> 0) WHERE worse >= 0.15)""", DENSE),
    "episode_score_linear": graded("""SELECT model, count(*) AS moments, count(*) FILTER (eta_us IS NOT NULL OR risk IS NOT NULL) AS answered, count(e) AS episodes, round(avg(abs(e)), 4) AS mae_h, round(avg(e), 4) AS bias_h, round(count(*) FILTER (eta_us IS NOT NULL OR risk IS NOT NULL) / count(*)::DOUBLE, 6) AS coverage FROM (
        SELECT c.model, c.eta_us, c.risk, (c.eta_us - (g.ts_us + g.realized_h * 3600000000.0::DOUBLE)) / 3600000000.0::DOUBLE AS e FROM (SELECT * FROM stored WHERE status NOT IN ('IDLE', 'NO_DATA', 'RESET_PENDING')) c ASOF JOIN known g ON c.account = g.account AND c.provider = g.provider AND c.kind = g.kind AND c.made_us >= g.ts_us) GROUP BY model"""),
    "brier_linear": graded("SELECT round(base, 6) AS base, count(outcome) AS n, round(avg(pow(risk - outcome, 2)), 4) AS brier, round(avg(CASE WHEN outcome IS NOT NULL THEN pow(base - outcome, 2) END), 4) AS base_brier, round(avg(CASE WHEN p90_us IS NOT NULL AND exhausted_us IS NOT NULL THEN CAST(exhausted_us <= p90_us AS INT) END), 4) AS p90_held FROM claims CROSS JOIN (SELECT avg(outcome) AS base FROM claims WHERE outcome IS NOT NULL) GROUP BY base", CLAIMS),
    "reliability_table_linear": graded("SELECT low, high, count(*) AS n, round(avg(outcome), 4) AS frequency FROM claims JOIN (VALUES (0.0::DOUBLE, 0.3::DOUBLE), (0.3, 0.6), (0.6, 0.9), (0.9, 1.01)) b(low, high) ON risk >= low AND risk < high WHERE outcome IS NOT NULL GROUP BY ALL", CLAIMS),
    "hour_of_week_profile": chain(LIVE, SEGMENTS, FACTS, profile("judged"), select=f"SELECT {K}, bucket, count(*) AS n, round(sum(v * w) / sum(w), 6) AS mean_burn FROM pool GROUP BY {K}, bucket"),
    "mc_outcomes": chain(LIVE, SEGMENTS, FACTS, "\nstart AS (SELECT *, burn AS live_burn, coalesce((resets_us - now_us) / 3600000000.0::DOUBLE, dur_us / 3600000000.0::DOUBLE) AS horizon_h FROM judged)", profile("start"), futures("start", RUNS), select=f"SELECT {K}, run, round(outcome_h, 4) AS outcome_h, round(level, 4) AS level FROM runs"),
    "mc_forecast": chain(LIVE, SEGMENTS, FACTS, *simulated(RUNS), select=SIM_COLUMNS),
    "alert_log": ALERTS,
    "streaming_alerts": ALERTS,
    "retained_prediction_linear": graded("""SELECT account, provider, kind, model, now_us, made_us, used, round(eta_us / 1e6, 2) AS eta_s, round(p90_us / 1e6, 2) AS p90_s FROM (
        SELECT i.account, i.provider, i.kind, 'linear' AS model, i.at AS now_us, i.used, i.dur_us, s.made_us, s.status, s.used AS saved_used, s.eta_us, s.p90_us FROM (SELECT account, provider, kind, now_us + 900000000 AS at, used, dur_us FROM lin) i
        ASOF JOIN (SELECT * FROM stored WHERE model = 'linear' AND status <> 'IDLE') s ON i.account = s.account AND i.provider = s.provider AND i.kind = s.kind AND i.at >= s.made_us)
        WHERE status = 'OK' AND eta_us IS NOT NULL AND saved_used = used AND made_us >= now_us - dur_us AND eta_us > now_us"""),
    "dashboard_cells": linear(f"""{WORK}
        SELECT {K},
        printf('%.0f', used) || '%' || CASE WHEN is_estimated THEN '*' ELSE '' END || CASE WHEN used >= 100 AND saturated_us IS NOT NULL AND n_over > 0 AND provider = 'claude' THEN format(' (+${{:,.2f}})', (over_in * 3.0::DOUBLE + over_out * 15.0 + over_new * 3.75 + over_read * 0.3) / 1e6)
            WHEN used >= 100 AND saturated_us IS NOT NULL AND n_tokens IS NOT NULL THEN ' (+' || CASE WHEN coalesce(over_tokens, 0) >= 1000000 THEN printf('%.1fM', round_even(over_tokens / 1e6, 1)) WHEN coalesce(over_tokens, 0) >= 1000 THEN printf('%.0fK', round_even(over_tokens / 1e3, 0)) ELSE CAST(coalesce(over_tokens, 0) AS VARCHAR) END || ')' ELSE '' END AS used_cell,
        CASE WHEN status = 'OK' AND eta_us IS NOT NULL AND resets_us IS NOT NULL THEN '🔥 burning' ELSE lower(status) END AS status_cell,
        CASE WHEN status <> 'OK' THEN '—' ELSE CASE WHEN burn_per_hour < 0 AND cents > 0 THEN '-' ELSE '+' END || printf('%d.%02d', cents // 100, cents % 100) || CASE WHEN basis = 'percent' THEN '~' ELSE '' END END AS burn_cell,
        CASE WHEN (status <> 'IDLE' OR in_cycle) AND used >= 90 THEN 'red' WHEN status = 'OK' AND eta_us IS NOT NULL AND resets_us IS NOT NULL THEN CASE WHEN used >= 25 AND (eta_us - now_us) / 3600000000.0::DOUBLE <= 1 THEN 'red' ELSE 'yellow' END END AS style,
        coalesce('hours ' || strftime(make_timestamp(CAST(CASE WHEN w < horizon_us THEN w END AS BIGINT)), '%a %H:%M'), '—') AS eta_cell
        FROM (SELECT *, b6 // 10000 + CASE WHEN b6 % 10000 > 5000 OR (b6 % 10000 = 5000 AND (b6 // 10000) % 2 = 1) THEN 1 ELSE 0 END AS cents FROM (SELECT *, CAST(round(abs(burn_per_hour) * 1e6) AS BIGINT) AS b6 FROM done))
        JOIN (SELECT account, provider, kind, ts_us AS now_us, is_estimated FROM smp) USING ({K})"""),
    "last_ten_alerts": FIRED + " SELECT * FROM fired QUALIFY row_number() OVER (PARTITION BY account ORDER BY fired_us DESC, provider DESC, kind DESC, alert DESC) <= 10",
    "dashboard_table": graded("""SELECT account, made_us, row_number() OVER (PARTITION BY account, made_us ORDER BY provider, kind) AS position, provider, kind,
        CASE WHEN count(risk) OVER (PARTITION BY account, made_us) > 0 THEN coalesce(CAST(CAST(round(risk * 100) AS INT) AS VARCHAR) || '%', '—') END AS risk_cell FROM stored WHERE model = 'linear'"""),
    "backtest_table_linear": graded("SELECT * FROM report", BY_SERIES, REPORT),
    "backtest_verdict_linear": graded("SELECT best, 500::BIGINT AS needed, best >= 500 AS enough FROM (SELECT CAST(coalesce(max(n), 0) AS BIGINT) AS best FROM (SELECT sum(dense_moments) AS n FROM report WHERE model <> 'persistence' GROUP BY model))", BY_SERIES, REPORT),
    "dashboard_mood": linear("SELECT account, now_us, CASE WHEN bool_or(status = 'OK' AND eta_us IS NOT NULL AND resets_us IS NOT NULL) THEN 'burning' WHEN bool_or((status <> 'IDLE' OR in_cycle) AND used >= 90) THEN 'alert' ELSE 'calm' END AS mood FROM lin GROUP BY account, now_us"),
    "latest_non_idle": linear("SELECT account, provider, kind, max(now_us) AS made_us, max(now_us) AS id, arg_max(used, now_us) AS used, arg_max(status, now_us) AS status FROM lin WHERE status <> 'IDLE' AND now_us <= 1705000000000000 GROUP BY ALL"),
    "snapshot_arbitration": f"""WITH {BASE}, r AS (SELECT *, ts_us // 86400000000 AS day, row_number() OVER (PARTITION BY account, provider, kind, ts_us // 86400000000 ORDER BY ts_us DESC) AS rank FROM smp),
        c AS (SELECT account, provider, kind, day, rank, ts_us, used, CASE WHEN rank % 2 = 0 THEN resets_us + rank * 45000000 WHEN rank < 5 THEN resets_us END AS resets_us FROM r WHERE rank <= 5),
        w AS (SELECT account, provider, kind, day, list_reduce(list(struct_pack(rank := rank, ts_us := ts_us, used := used, resets_us := resets_us) ORDER BY rank), lambda s, x: CASE WHEN {WINS} THEN x ELSE s END) AS s FROM c GROUP BY ALL)
        SELECT account, provider, kind, day, s.rank AS rank, s.ts_us AS ts_us, s.used AS used, s.resets_us AS resets_us FROM w""",
    "read_throttle": folded(
        "\nnone AS (SELECT 1 AS x)",
        [],
        "SELECT *, account || '|' || day AS key, row_number() OVER (PARTITION BY account, day ORDER BY ts_us) AS n FROM (SELECT account, ts_us // 86400000000 AS day, ts_us, total_tokens % 3 <> 0 AS ok FROM tok)",
        "-1::BIGINT AS next_us, 180::BIGINT AS wait_s, NULL::BIGINT AS good, false AS tried, false AS served",
        f"CASE WHEN {TRIED} THEN i.ts_us + {WAIT} * 1000000 ELSE f.next_us END, CASE WHEN {TRIED} THEN {WAIT} ELSE f.wait_s END, {GOOD}, {TRIED}, coalesce({GOOD} > i.ts_us - 900000000, false)",
        "SELECT account, day, ts_us, tried, wait_s, served FROM fold JOIN inputs USING (key, n)",
    ),
    "source_choice": f"""WITH {BASE}, s AS (SELECT account, provider, kind, arg_max(used, ts_us) AS used FROM smp GROUP BY ALL)
        SELECT account, provider, kind, used, CASE WHEN length(account) % 4 = 0 AND kind = 'w5h' THEN 'cli' WHEN length(account) % 2 = 0 THEN 'desktop' ELSE 'tokens' END AS source FROM s""",
    "keep_first_insert": f"""WITH {BASE}, h AS (SELECT account, provider, kind, ts_us // 3600000000 * 3600000000 AS ts_us, used, ts_us AS seq FROM smp), f AS (SELECT * FROM h WHERE ts_us >= {DAY0 + 86_400_000_000} AND ts_us >= {DAY0 + 864_000_000_000})
        SELECT account, provider, kind, ts_us, arg_min(used, seq) AS used, min(seq) AS seq FROM f GROUP BY ALL""",
    "keep_last_upsert": f"""WITH {BASE}, h AS (SELECT provider, request_id, CAST(ts_us // 3600000000 AS VARCHAR) AS message_id, ts_us, total_tokens FROM tok)
        SELECT provider, request_id, message_id, max(ts_us) AS ts_us, arg_max(total_tokens, ts_us) AS total_tokens FROM h GROUP BY ALL""",
    "recent_samples": f"WITH {BASE} SELECT account, provider, kind, ts_us, used FROM smp WHERE provider = 'codex' AND kind = 'w5h' AND ts_us >= 1706000000000000",
    "recent_token_events": f"WITH {BASE} SELECT account, message_id, ts_us, total_tokens FROM tok WHERE provider = 'claude' AND ts_us >= 1706000000000000",
    "recent_forecasts": linear("SELECT account, provider, kind, now_us AS made_us, status, round(burn_per_hour, 6) AS burn_per_hour FROM lin WHERE provider = 'codex' AND kind = 'weekly' AND now_us >= 1706000000000000"),
    "pruned_and_deleted": f"WITH {BASE} SELECT provider, request_id, message_id, ts_us FROM tok WHERE total_tokens % 7 <> 0 AND ts_us >= 1705000000000000",
    "reset_history_count": f"WITH {BASE} SELECT CAST((SELECT count(*) FROM smp) + (SELECT count(*) FROM tok) AS BIGINT) AS removed",
    "last_alerts": f"WITH {BASE}, {TRUTHS} SELECT account, provider, kind, ts_us FROM blocked WHERE cut QUALIFY row_number() OVER (PARTITION BY account, provider, kind ORDER BY ts_us DESC) <= 10",
    "conversation_words": "SELECT 'claude' AS provider, CAST(conv_id AS VARCHAR) AS request_id, CAST(turn AS VARCHAR) AS message_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n\\t\\r]+'), lambda w: w <> '')) AS output_tokens FROM conversations WHERE role = 'assistant'",
    "transcript_tokens": """WITH t AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n\\t\\r]+'), lambda w: w <> '')) AS words FROM conversations WHERE role = 'assistant' AND conv_id % 11 <> 0 AND turn % 5 <> 4)
        SELECT 'claude' AS provider, CAST(conv_id AS VARCHAR) AS request_id, 'm' || (turn % 3) AS message_id, CAST(max(1704067200 + conv_id * 60 + turn) * 1000000 AS BIGINT) AS ts_us, 'x' AS model, CAST(max(turn) AS BIGINT) AS input_tokens,
            CAST(arg_max(words, turn) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_creation, CAST(arg_max(CASE WHEN turn % 2 = 0 THEN conv_id ELSE 0 END, turn) AS BIGINT) AS cache_read FROM t GROUP BY conv_id, turn % 3""",
    "rollout_suppression": f"""WITH {BASE}, r AS (SELECT request_id, CAST(message_id AS BIGINT) AS pos, CASE WHEN total_tokens % 5 <> 0 THEN total_tokens // 9000 END AS total FROM tok),
        b AS (SELECT *, last_value(total IGNORE NULLS) OVER (PARTITION BY request_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) SELECT request_id, pos, total FROM b WHERE NOT coalesce(total = before, false)""",
    "rollout_blocks": f"""WITH {BASE}, e AS (SELECT *, CAST(message_id AS BIGINT) AS pos FROM tok WHERE total_tokens % 4 <> 0)
        SELECT pos, 0 AS block, CASE WHEN total_tokens % 3 = 0 THEN 'w5h' ELSE 'weekly' END AS kind, total_tokens % 100 + 0.5::DOUBLE AS used, ts_us // 1000000 * 1000000 + total_tokens % 977 * 1000000 AS resets_us, input_tokens, output_tokens FROM e WHERE total_tokens % 3 < 2
        UNION ALL SELECT pos, 1, 'weekly', CAST(total_tokens % 50 AS DOUBLE), (total_tokens + 1700000000) * 1000000, input_tokens, output_tokens FROM e WHERE total_tokens % 5 <> 0""",
    "cli_text": f"""WITH {BASE}, n AS (SELECT ts_us AS now_us, total_tokens AS t FROM tok),
        a AS (SELECT *, CASE WHEN t % 31 + 1 <= 29 AND t % 11 <> 0 AND t % 7 <> 0 THEN epoch_us(make_timestamp(2024, 2, CAST(least(t % 31 + 1, 29) AS BIGINT), (t % 12 + 1) % 12 + 12, t % 60, 0.0)) END AS at_us FROM n)
        SELECT now_us, CASE WHEN t % 2 = 0 THEN 'w5h' ELSE 'weekly' END AS kind, CAST(t % 101 AS DOUBLE) AS used, at_us AS resets_us FROM a WHERE t % 2 = 0 OR t % 3 <> 0""",
    "rpc_results": f"""WITH {BASE} SELECT ts_us AS now_us, 'w5h' AS kind, CAST(total_tokens % 100 AS DOUBLE) AS used, (total_tokens + 1700000000) * 1000000 AS resets_us FROM tok WHERE total_tokens % 2 = 0 AND total_tokens % 4 <> 0
        UNION ALL SELECT ts_us, 'weekly', CAST(total_tokens % 99 AS DOUBLE), NULL FROM tok""",
}
