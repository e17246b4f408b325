"""The registered queries as plain SQL for an independent engine."""

from __future__ import annotations

from tidewatch.plans.inputs import ACTIONS, LEXICON, SHARDS
from tidewatch.plans.registered import SLIDE, TRACKED, WINDOW

_LEX = "lexicon(word, score) AS (VALUES " + ", ".join(f"('{w}', {s})" for w, s in LEXICON) + ")"
_TOKENS = f"""{_LEX},
tok AS (SELECT doc_id, unnest(list_filter(string_split(
  lower(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g')), ' '), lambda x: x <> '')) AS word
  FROM documents),
scores AS (SELECT doc_id, CAST(sum(score) AS BIGINT) AS score
  FROM tok JOIN lexicon USING (word) GROUP BY doc_id)"""

_RE = (r'^(\S+) (\S+) (\S+) \[([\w:/]+\s[+\-]\d{4})\] "(.+?)" (\d{3}) (\S+)(.*?)$')
_OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPRE = rf"{_OCT}\.{_OCT}\.{_OCT}\.{_OCT}"
_LOG = rf"""lines AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'broken ' || ip ELSE
  ip || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0100] "GET /' || event_type || '?u='
  || user_id || ' HTTP/1.1" ' || (200 + 100 * (event_id % 4)) || ' ' ||
  CASE WHEN event_id % 5 = 0 THEN '-' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END
  || ' "-" "agent"' END AS line
  FROM (SELECT *, (user_id % 256) || '.' || (event_id % 300) || '.0.' || (event_id % 7) AS ip
        FROM events)),
log AS (SELECT event_id, regexp_extract(line, '{_RE}', 1) AS ip,
  regexp_extract(line, '{_RE}', 4) AS log_timestamp,
  date_trunc('minute', strptime(regexp_extract(line, '{_RE}', 4), '%d/%b/%Y:%H:%M:%S %z')
    AT TIME ZONE 'UTC') AS minute,
  regexp_extract(line, '{_RE}', 5) AS request,
  CAST(regexp_extract(line, '{_RE}', 6) AS INTEGER) AS response,
  coalesce(try_cast(regexp_extract(line, '{_RE}', 7) AS BIGINT), 0) AS byte_size
  FROM lines WHERE regexp_matches(line, '{_RE}')),
valid AS (SELECT event_id, ip, list_reduce(list_transform(string_split(ip, '.'),
    lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) AS num
  FROM log WHERE regexp_full_match(ip, '{_IPRE}')),
spread AS (SELECT n_name, CAST(n_nationkey AS BIGINT) AS k, i,
    CAST(n_nationkey AS BIGINT) * 10 + i AS o FROM nation, range(10) t(i)),
geo AS (
  SELECT o * 16777216 AS net_start, o * 16777216 + 16777215 AS net_end, 8 AS prefix_len,
    n_name AS country, CASE WHEN k % 2 = 0 THEN 'City of ' || n_name END AS city FROM spread
  UNION ALL
  SELECT o * 16777216 + o * 65536, o * 16777216 + o * 65536 + 65535, 16, n_name, 'Port ' || i
  FROM spread),
best AS (SELECT event_id, arg_max({{'country': country, 'city': city}}, prefix_len) AS g
  FROM valid JOIN geo ON num BETWEEN net_start AND net_end GROUP BY event_id),
located AS (SELECT v.event_id, v.ip, coalesce(g.country, 'null') AS country,
  coalesce(g.city, 'null') AS city FROM valid v LEFT JOIN best USING (event_id)),
cities AS (SELECT country, city, count(*) AS city_total FROM located GROUP BY ALL)"""
_VOLUME = """SELECT event_id, minute, count(*) OVER (PARTITION BY minute ORDER BY event_id)
  AS count FROM log"""
_STATUS = """SELECT event_id, response, count(*) OVER (PARTITION BY response ORDER BY event_id)
  - 1 AS count FROM log"""
_GEO = """SELECT event_id, country, city,
  count(*) OVER (PARTITION BY country ORDER BY event_id) AS country_total,
  count(*) OVER (PARTITION BY country, city ORDER BY event_id) AS city_total FROM located"""

_USAGE = """usage AS (SELECT event_id, user_id AS machine_id, date_trunc('hour', ts) AS tick,
  value / 100 AS cpu, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS memory FROM events)"""
_OBS = """1.0 + sqrt(pow(cpu - avg(cpu) OVER (PARTITION BY tick), 2)
  + pow(memory / 100 - avg(memory / 100) OVER (PARTITION BY tick), 2))"""
_SCORED = f"""{_USAGE}, scored AS (SELECT event_id, machine_id, tick, round({_OBS}, 9) AS score
  FROM usage)"""
_SLIDING = f"""{_SCORED}, sliding AS (SELECT *, sum(score) OVER (PARTITION BY machine_id
  ORDER BY tick, event_id ROWS 9 PRECEDING) AS anomaly_score FROM scored)"""


def _decayed(scope: str = "0") -> str:
    """Tick by tick: fold each machine's scores of the tick into its profile, then
    zero the scope if one passed the limit. Every machine has a row per tick."""
    return f"""{_SCORED},
nos AS (SELECT *, {scope} AS scope FROM scored),
ticks AS MATERIALIZED (SELECT scope, tick, row_number() OVER (PARTITION BY scope ORDER BY tick) AS t
  FROM (SELECT DISTINCT scope, tick FROM nos)),
obs AS MATERIALIZED (SELECT scope, machine_id, t, count(*) AS k,
    sum(score * exp(-0.017 * (c - r))) AS d, arg_max(score, r) AS last
  FROM (SELECT nos.*, t, row_number() OVER w AS r,
          count(*) OVER (PARTITION BY nos.scope, machine_id, t) AS c
        FROM nos JOIN ticks USING (scope, tick)
        WINDOW w AS (PARTITION BY nos.scope, machine_id, t ORDER BY event_id))
  GROUP BY ALL),
walk(scope, machine_id, t, p, last) AS (
  SELECT DISTINCT scope, machine_id, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE),
    CAST(NULL AS DOUBLE) FROM nos
  UNION ALL
  SELECT scope, machine_id, t, CASE WHEN p IS NOT NULL AND
      bool_or(tested AND p > 0.5 / (1 - exp(-0.017))) OVER (PARTITION BY scope)
      THEN 0.0 ELSE p END, last
  FROM (SELECT w.scope, w.machine_id, w.t + 1 AS t, coalesce(o.last, w.last) AS last,
          CASE WHEN o.k IS NULL THEN w.p
               ELSE coalesce(w.p, 0) * exp(-0.017 * o.k) + o.d END AS p,
          o.k IS NOT NULL AND (w.p IS NOT NULL OR o.k > 1) AS tested
        FROM walk w
        JOIN (SELECT scope, max(t) AS top FROM ticks GROUP BY scope) m ON m.scope = w.scope
        LEFT JOIN obs o ON o.scope = w.scope AND o.machine_id = w.machine_id AND o.t = w.t + 1
        WHERE w.t < m.top)),
profiles AS (SELECT tick, machine_id, p AS anomaly_score, last AS score
  FROM walk JOIN ticks USING (scope, t) WHERE p IS NOT NULL)"""


_DECAYED = "WITH RECURSIVE " + _decayed()
_LINES7 = """concat_ws(',', CAST(user_id AS VARCHAR), CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR),
  CAST(value AS VARCHAR), json_extract_string(props, '$.k'),
  CASE WHEN event_id % 11 = 0 THEN '' ELSE 'x' END, 'a', 'b')"""
_LINES19 = """concat_ws(',', CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR), '1', '2',
  CASE WHEN event_id % 11 = 0 THEN '' ELSE 'x' END, CAST(user_id AS VARCHAR),
  CAST(value AS VARCHAR), json_extract_string(props, '$.k'), """ + ", ".join(["'z'"] * 12) + ")"


def _machine(lines: str, size: int, i: int, t: int, c: int, m: int, tf: int, f: str) -> str:
    return f"""SELECT event_id, f[{i}] AS machine_id, CAST(f[{t}] AS BIGINT) * {tf} AS ts,
  round(CAST(f[{c}] AS DOUBLE) * {f}, 6) AS cpu, round(CAST(f[{m}] AS DOUBLE) * {f}, 6) AS memory
  FROM (SELECT event_id, list_filter(string_split({lines}, ','), lambda x: x <> '') AS f
        FROM events) WHERE len(f) = {size}"""


_TOPICS = """topics AS (SELECT event_id, ts, word FROM (SELECT event_id, ts,
  unnest(regexp_split_to_array('#' || event_type || E' by\\t#user' || user_id || E'\\nnow # '
    || event_type, E'[ \\n\\t]+')) AS word FROM events) WHERE starts_with(word, '#'))"""
_STEP = SLIDE * 1_000_000
_WIDTH = WINDOW * 1_000_000
_COUNTS = f"""{_TOPICS},
hits AS (SELECT word, unnest(range((epoch_us(ts) - {_WIDTH}) // {_STEP} + 1,
  epoch_us(ts) // {_STEP} + 1)) AS idx FROM topics),
cnt AS (SELECT word, idx, count(*) AS count FROM hits GROUP BY ALL),
zeros AS (SELECT word, idx + 1 AS idx, 0 AS count FROM cnt
  WHERE (word, idx + 1) NOT IN (SELECT (word, idx) FROM cnt)),
counts AS (SELECT make_timestamp(idx * {_STEP}) AS window_start,
  make_timestamp(idx * {_STEP} + {_WIDTH}) AS window_end, word, count FROM cnt)"""
_HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_PARTIAL = f"""{_COUNTS},
sharded AS (SELECT *, CAST({_HASH.format("'shard:' || word")} % 8 AS INTEGER) AS shard FROM counts),
partials AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_end, shard
  ORDER BY count DESC, word) AS rank FROM sharded) WHERE rank <= 10),
total AS (SELECT * FROM (SELECT window_start, window_end, word, count, row_number() OVER (
  PARTITION BY window_end ORDER BY count DESC, word) AS rank FROM counts) WHERE rank <= 10)"""

_ACTIONS = ", ".join(f"'{a}'" for a in ACTIONS)
_INPUT = f"""inp AS (
  SELECT 'event' AS tag, CAST(event_id AS VARCHAR) AS id, CAST(NULL AS BIGINT) AS value, ts,
    event_id AS seq, CAST(event_id % {SHARDS} AS INTEGER) AS shard
  FROM events WHERE event_type = 'view'
  UNION ALL
  SELECT 'reward', event_type, CAST(floor(value) AS BIGINT), ts, event_id, CAST(s AS INTEGER)
  FROM events, range({SHARDS}) t(s) WHERE event_type IN ({_ACTIONS}))"""
_ASKED = f"""{_INPUT},
asked AS (SELECT id, shard, ts, seq, 1 + row_number() OVER (PARTITION BY shard ORDER BY ts, seq)
  AS round FROM inp WHERE tag = 'event'),
acts(action, i) AS (SELECT unnest([{_ACTIONS}]), unnest(range({len(ACTIONS)}))),
told AS (SELECT shard, id AS action, value, ts, seq,
  row_number() OVER (PARTITION BY shard, id ORDER BY ts, seq) AS n,
  sum(value) OVER (PARTITION BY shard, id ORDER BY ts, seq) AS s FROM inp WHERE tag = 'reward'),
hist AS (SELECT a.id, a.shard, a.ts, a.seq, a.round, c.action, coalesce(r.n, 0) AS n,
    coalesce(r.s, 0) AS s
  FROM (SELECT * FROM asked, acts) a JOIN acts c USING (action)
  ASOF LEFT JOIN told r ON r.shard = a.shard AND r.action = a.action AND r.ts <= a.ts)"""


def _u(seed: str, what: str, key: str = "id") -> str:
    return f"({_HASH.format(f"'{seed}:{what}:' || {key}")} / 4294967296.0::DOUBLE)"


def _any(seed: str) -> str:
    names = "[" + _ACTIONS + "]"
    return f"{names}[1 + CAST(floor({_u(seed, 'action')} * {len(ACTIONS)}) AS INTEGER)]"


def _greedy(probability: str) -> str:
    return f"""WITH {_ASKED},
top AS (SELECT id, shard, ts, round, max(m) AS m, arg_max(action, (m, -i)) AS action
  FROM (SELECT h.*, i, CASE WHEN n > 0 THEN CAST(trunc(s / n) AS BIGINT) ELSE 0 END AS m
        FROM hist h JOIN acts USING (action)) GROUP BY ALL)
SELECT id AS event_id, shard, ts, round, CASE
  WHEN NOT (least({probability}, 0.5) < {_u('greedy', 'explore')}) AND m > 0 THEN action
  ELSE {_any('greedy')} END AS action FROM top"""


def _sampler(optimistic: bool) -> str:
    drawn = "greatest(o.value, CAST(trunc(h.s / h.n) AS BIGINT))" if optimistic else "o.value"
    return f"""WITH {_ASKED},
draws AS (SELECT *, {_HASH.format("'sampler:' || action || ':' || id")} / 4294967296.0::DOUBLE AS u
  FROM hist),
vals AS (SELECT h.id, h.shard, h.ts, h.round, h.action, CASE WHEN h.n > 10 THEN {drawn}
    ELSE CAST(floor(u * 100) AS BIGINT) END AS v
  FROM draws h LEFT JOIN told o ON h.n > 10 AND o.shard = h.shard AND o.action = h.action
    AND o.n - 1 = CAST(floor(h.u * h.n) AS BIGINT)),
top AS (SELECT id, shard, ts, round, max(v) AS v, arg_max(action, (v, -i)) AS action
  FROM vals JOIN acts USING (action) GROUP BY id, shard, ts, round)
SELECT id AS event_id, shard, ts, round, CASE WHEN v > 0 THEN action
  ELSE {_any('sampler')} END AS action FROM top"""


_INTERVAL = f"""WITH {_ASKED},
ready AS (SELECT id, min(n) >= 30 AS ok FROM hist GROUP BY id),
began AS (SELECT shard, min(round) AS r0 FROM asked JOIN ready USING (id) WHERE ok GROUP BY shard),
lim AS (SELECT a.*, ok, greatest(95 - 5 * ((round - r0) // 50), 50) AS pct
  FROM asked a JOIN ready USING (id) LEFT JOIN began USING (shard)),
bins AS (SELECT a.id, r.action, r.value // 10 AS bin, count(*) AS c
  FROM lim a JOIN told r ON a.ok AND r.shard = a.shard AND r.ts <= a.ts GROUP BY ALL),
far AS (SELECT b.*, CAST(trunc(h.s / h.n) AS BIGINT) // 10 AS m, h.n * l.pct // 100 AS need,
    abs(b.bin - CAST(trunc(h.s / h.n) AS BIGINT) // 10) AS off
  FROM bins b JOIN hist h USING (id, action) JOIN lim l USING (id)),
cov AS (SELECT *, sum(c) OVER (PARTITION BY id, action ORDER BY off) AS cum FROM far),
ub AS (SELECT id, action, CAST(trunc((any_value(m) + greatest(min(off) FILTER (cum >= need), 1)
    + 0.5) * 10) AS BIGINT) AS ub FROM cov GROUP BY id, action),
top AS (SELECT id, arg_max(action, (ub, -i)) AS action FROM ub JOIN acts USING (action) GROUP BY id)
SELECT id AS event_id, shard, ts, round,
  CASE WHEN ok THEN action ELSE {_any('interval')} END AS action
FROM lim LEFT JOIN top USING (id)"""

_P = (0, 5, 25, 50, 75, 95, 100)


def _dist(key: str, source: str, ps=_P) -> str:
    picks = ", ".join(f"round(max(v) FILTER (r = CAST(floor((n - 1) * CAST({p / 100} AS DOUBLE)) "
                      f"AS BIGINT)), 6) AS p{p}" for p in ps)
    return f"""SELECT {key}, any_value(n) AS samples, round(avg(v), 6) AS mean, {picks}
  FROM (SELECT {key}, value AS v, row_number() OVER (PARTITION BY {key} ORDER BY value) - 1 AS r,
        count(*) OVER (PARTITION BY {key}) AS n FROM {source}) GROUP BY {key}"""


_RUNS = """runs AS (SELECT 'app-' || event_type || '-mean' AS name, event_type, day(ts) AS day,
  avg(value) AS mean, CASE day(ts) % 3 WHEN 0 THEN [0, 0] WHEN 1 THEN [0, 16] ELSE [64, 16] END
  AS sizes FROM events GROUP BY ALL)"""
_ARRIVALS = """arr AS (SELECT event_id, event_type, ts, date_trunc('hour', ts) AS tick,
  make_timestamp(epoch_us(ts) + CAST(round(value * 1e6) AS BIGINT)) AS arrival FROM events)"""
_FAR = """far AS (SELECT event_type, bin, count, total, mean, mean // 10 AS m,
    total * 95 // 100 AS need, abs(bin - mean // 10) AS off FROM hist),
cov AS (SELECT *, sum(count) OVER (PARTITION BY event_type ORDER BY off) AS cum FROM far),
o AS (SELECT event_type, any_value(mean) AS mean, any_value(m) AS m,
  greatest(min(off) FILTER (cum >= need AND need > 0), 1) AS off FROM cov GROUP BY event_type)"""
_HIST = """bins AS (SELECT event_type, CAST(floor(value) AS BIGINT) // 10 AS bin, count(*) AS count,
    sum(CAST(floor(value) AS BIGINT)) AS s FROM events GROUP BY ALL),
hist AS (SELECT event_type, bin, count, CAST(sum(count) OVER w AS BIGINT) AS total,
  CAST(trunc(sum(s) OVER w / sum(count) OVER w) AS BIGINT) AS mean FROM bins
  WINDOW w AS (PARTITION BY event_type))"""

ORACLE: dict[str, str] = {
    "sa_clean": """SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g')) AS clean
  FROM documents""",
    "sa_word_hits": f"""WITH {_TOKENS} SELECT doc_id, word, coalesce(score, 0) AS score,
  count(*) AS n FROM tok LEFT JOIN lexicon USING (word) GROUP BY ALL""",
    "sa_score": f"""WITH {_TOKENS} SELECT doc_id, coalesce(score, 0) AS score
  FROM documents LEFT JOIN scores USING (doc_id)""",
    "sa_classify": f"""WITH {_TOKENS} SELECT doc_id,
  lower(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g')) AS text, coalesce(score, 0) AS score,
  CASE WHEN score > 0 THEN 'Positive' WHEN score < 0 THEN 'Negative' ELSE 'Neutral' END AS sentiment
  FROM documents LEFT JOIN scores USING (doc_id)""",
    "lp_parse_log": f"WITH {_LOG} SELECT * FROM log",
    "lp_valid_ip": f"WITH {_LOG} SELECT event_id, ip FROM valid",
    "lp_geo_lookup": f"WITH {_LOG} SELECT * FROM located",
    "lp_volume_running": f"WITH {_LOG} {_VOLUME}",
    "lp_volume_by_minute": f"WITH {_LOG} SELECT minute, count(*) AS count FROM log GROUP BY minute",
    "lp_status_running": f"WITH {_LOG} {_STATUS}",
    "lp_status_totals": f"WITH {_LOG} SELECT response, count(*) AS count FROM log GROUP BY response",
    "lp_geo_running": f"WITH {_LOG} {_GEO}",
    "lp_geo_rollup": f"""WITH {_LOG} SELECT country, city, count(*) AS total,
  CAST(grouping(country, city) AS INTEGER) AS level FROM located GROUP BY ROLLUP (country, city)""",
    "lp_geo_totals": f"""WITH {_LOG} SELECT country, city, city_total, country_total,
  round(city_total / country_total, 6) AS city_share FROM (SELECT *, CAST(sum(city_total) OVER (
  PARTITION BY country) AS BIGINT) AS country_total FROM cities)""",
    "lp_split_counts": f"""WITH {_LOG} SELECT tag, count(*) AS n FROM log,
  (VALUES ('Volume'), ('Status'), ('Geo')) t(tag) GROUP BY tag""",
    "lp_all_branches": f"""WITH {_LOG},
v AS ({_VOLUME}), s AS ({_STATUS}), g AS ({_GEO})
SELECT 'Volume' AS tag, event_id, NULL AS country, NULL AS city, NULL AS country_total,
  NULL AS city_total, NULL AS status_code, minute, count FROM v
UNION ALL SELECT 'Status', event_id, NULL, NULL, NULL, NULL, response, NULL, count FROM s
UNION ALL SELECT 'Geo', event_id, country, city, country_total, city_total, NULL, NULL, NULL FROM g""",
    "mo_parse_seven": _machine(_LINES7, 7, 1, 2, 3, 4, 1000, "1"),
    "mo_parse_nineteen": _machine(_LINES19, 19, 5, 1, 6, 7, 1, "10"),
    "mo_observation_score": f"""WITH {_USAGE} SELECT event_id, machine_id, tick,
  round(cpu, 6) AS cpu, memory, round({_OBS}, 6) AS score FROM usage""",
    "mo_anomaly_sliding": f"""WITH {_SLIDING} SELECT event_id, machine_id, tick,
  round(score, 6) AS score, round(anomaly_score, 6) AS anomaly_score FROM sliding""",
    "mo_anomaly_decayed": f"""{_DECAYED} SELECT tick, machine_id,
  round(anomaly_score, 6) AS anomaly_score, round(score, 6) AS score FROM profiles""",
    "mo_anomaly_decayed_by_machine": f"""WITH RECURSIVE {_decayed('machine_id')}
SELECT tick, machine_id, round(anomaly_score, 6) AS anomaly_score, round(score, 6) AS score
FROM profiles""",
    "mo_carry_forward": f"""WITH {_USAGE},
latest AS (SELECT machine_id, tick, arg_max(cpu, event_id) AS cpu,
  arg_max(memory, event_id) AS memory FROM usage GROUP BY ALL),
spine AS (SELECT machine_id, tick FROM (SELECT DISTINCT machine_id FROM usage),
  (SELECT DISTINCT tick FROM usage))
SELECT tick, machine_id, round(cpu, 6) AS cpu, memory FROM (SELECT s.tick, s.machine_id,
    last_value(cpu IGNORE NULLS) OVER w AS cpu, last_value(memory IGNORE NULLS) OVER w AS memory
  FROM spine s LEFT JOIN latest l ON l.machine_id = s.machine_id AND l.tick = s.tick
  WINDOW w AS (PARTITION BY s.machine_id ORDER BY s.tick)) WHERE cpu IS NOT NULL""",
    "mo_alert_topk": f"""WITH {_SLIDING} SELECT event_id, machine_id, tick,
  round(score, 6) AS score, round(anomaly_score, 6) AS anomaly_score,
  row_number() OVER (PARTITION BY tick ORDER BY anomaly_score DESC, event_id) <= 3 AS is_abnormal
  FROM sliding""",
    "mo_stream_topk": f"""{_DECAYED} SELECT tick, machine_id, round(anomaly_score, 6)
  AS anomaly_score, round(score, 6) AS score, row_number() OVER (PARTITION BY tick
  ORDER BY anomaly_score DESC, machine_id) <= 3 AS is_abnormal FROM profiles""",
    "mo_anomaly_decayed_by_shard": f"""WITH RECURSIVE {_decayed('machine_id % 4')}
SELECT tick, machine_id, round(anomaly_score, 6) AS anomaly_score, round(score, 6) AS score
FROM profiles""",
    "mo_alert_threshold": f"""{_DECAYED},
placed AS (SELECT *, row_number() OVER w - 1 AS pos, first_value(anomaly_score) OVER w AS low,
    first_value(score) OVER w AS ind, count(*) OVER (PARTITION BY tick) AS n FROM profiles
  WINDOW w AS (PARTITION BY tick ORDER BY score, machine_id)),
mid AS (SELECT tick, anomaly_score AS med FROM placed WHERE pos = n // 2)
SELECT tick, machine_id, round(anomaly_score, 6) AS anomaly_score, round(score, 6) AS score,
  true AS is_abnormal FROM placed JOIN mid USING (tick)
WHERE anomaly_score > 2 * med - low AND anomaly_score > low + 2 * sqrt(2.0)
  AND anomaly_score > CAST(0.1 AS DOUBLE) + ind""",
    "replay_shifted": """SELECT event_id, CAST(i AS INTEGER) AS round, make_timestamp(epoch_us(ts) + i *
  (SELECT epoch_us(arg_max(ts, event_id)) FROM events)) AS ts FROM events, range(3) t(i)""",
    "tt_topics": f"WITH {_TOPICS} SELECT * FROM topics",
    "tt_rolling_counts": f"WITH {_COUNTS} SELECT * FROM counts",
    "tt_rolling_counts_with_zeros": f"""WITH {_COUNTS} SELECT * FROM counts UNION ALL
SELECT make_timestamp(idx * {_STEP}), make_timestamp(idx * {_STEP} + {_WIDTH}), word, count
FROM zeros""",
    "tt_window_length": f"""WITH {_COUNTS} SELECT emit_ts, (epoch_us(emit_ts) - epoch_us(coalesce(
  lag(emit_ts, {TRACKED}) OVER (ORDER BY emit_ts), min(emit_ts) OVER ()))) // 1000000
  AS window_seconds FROM (SELECT DISTINCT window_end AS emit_ts FROM counts)""",
    "tt_trending": f"""WITH {_TOPICS},
hits AS (SELECT word, unnest(range((epoch_us(ts) - 300000000) // 2000000 + 1,
  epoch_us(ts) // 2000000 + 1)) AS idx FROM topics),
counts AS (SELECT idx, word, count(*) AS count FROM hits GROUP BY ALL)
SELECT make_timestamp(idx * 2000000 + 300000000) AS window_end, rank, word, count
FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY count DESC, word) AS rank
  FROM counts) WHERE rank <= 10""",
    "tt_partial_topn": f"WITH {_PARTIAL} SELECT * FROM partials",
    "tt_total_topn": f"WITH {_PARTIAL} SELECT * FROM total",
    "tt_rankings": f"""WITH {_PARTIAL} SELECT window_end,
  string_agg(word || ':' || count, ' ' ORDER BY rank) AS rankings FROM total GROUP BY window_end""",
    "rl_shard_input": f"WITH {_INPUT} SELECT * FROM inp",
    "rl_every_nth": """SELECT event_type, ts, event_id FROM (SELECT *, row_number() OVER (
  PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r % 50 = 0""",
    "rl_histogram": f"WITH {_HIST} SELECT * FROM hist",
    "rl_confidence_bounds": f"""WITH {_HIST}, {_FAR}
SELECT event_type, mean, greatest(CAST(trunc((m - off + 0.5) * 10) AS BIGINT), 0) AS lower,
  greatest(CAST(trunc((m + off + 0.5) * 10) AS BIGINT), 0) AS upper FROM o""",
    "rl_mean_reward": """SELECT event_type, round(avg(floor(value)), 6) AS mean,
  CAST(trunc(avg(floor(value))) AS BIGINT) AS mean_int FROM events GROUP BY event_type""",
    "rl_random_greedy": _greedy("CAST(0.5 AS DOUBLE) / round"),
    "rl_random_greedy_log": _greedy("CAST(0.5 AS DOUBLE) * ln(round) / round"),
    "rl_sampler": _sampler(False),
    "rl_optimistic_sampler": _sampler(True),
    "rl_interval_estimator": _INTERVAL,
    "metric_distribution": _dist("event_type", "events"),
    "metric_distribution_by_tag": f"""WITH t AS (SELECT event_type AS tag, value FROM events
  UNION ALL SELECT 'overall', value FROM events) {_dist('tag', 't')}""",
    "metric_throughput": """SELECT event_type, sent, round(e, 6) AS elapsed_seconds,
  round(sent / e, 6) AS throughput, round(1 / (sent / e), 6) AS service_seconds
  FROM (SELECT event_type, count(*) AS sent, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS e
        FROM events GROUP BY event_type)""",
    "latency_by_row": f"""WITH {_ARRIVALS} SELECT event_id, epoch_us(arrival) - epoch_us(ts)
  AS latency_us FROM arr""",
    "latency_parent": f"""WITH {_ARRIVALS} SELECT tick, arg_min(arrival, event_id) AS parent_ts
  FROM arr GROUP BY tick""",
    "latency_sampled": f"""WITH RECURSIVE {_ARRIVALS},
s AS (SELECT event_id, CAST(event_id % 4 AS INTEGER) AS shard, epoch_us(arrival) AS a,
  epoch_us(arrival) - epoch_us(ts) AS latency_us FROM arr),
kept(shard, a, event_id, latency_us) AS (
  SELECT shard, min(a), arg_min(event_id, (a, event_id)), arg_min(latency_us, (a, event_id))
  FROM s GROUP BY shard
  UNION ALL
  SELECT s.shard, min(s.a), arg_min(s.event_id, (s.a, s.event_id)),
    arg_min(s.latency_us, (s.a, s.event_id))
  FROM kept k JOIN s ON s.shard = k.shard AND s.a >= k.a + 1800000000 GROUP BY s.shard)
SELECT event_id, shard, latency_us FROM kept""",
    "metric_select": f"""WITH {_RUNS} SELECT name, CAST(day AS INTEGER) AS parallelism,
  round(mean, 6) AS mean FROM runs WHERE list_contains(sizes, 16) AND day % 4 <> 0
  AND day % 5 < 3 AND day % 7 <> 0 AND day % 6 <> 0""",
    "metric_series": f"""WITH {_RUNS} SELECT 'b = ' || b AS label, CAST(day AS INTEGER) AS x,
  round(mean, 6) AS y FROM runs, (VALUES (0), (16), (64), (99)) t(b) 
  WHERE CASE WHEN b = 0 THEN sizes = [0, 0] ELSE list_contains(sizes, b) END""",
    "metric_series_parallelism": f"""WITH {_RUNS} SELECT 'p = ' || p AS label,
  CASE day % 3 WHEN 0 THEN 0 WHEN 1 THEN 16 ELSE 64 END AS x, round(mean, 6) AS y
  FROM (SELECT *, CAST(day AS INTEGER) AS p FROM runs)""",
    "metric_series_chaining": f"""WITH {_RUNS} SELECT 'Chaining: ' || CASE WHEN day % 4 <> 0
  THEN 'enabled' ELSE 'disabled' END AS label, CAST(day AS INTEGER) AS x, round(mean, 6) AS y
  FROM runs""",
    "metric_series_execution_mode": f"""WITH {_RUNS} SELECT CASE WHEN day % 7 = 0
  THEN 'DETERMINISTIC' ELSE 'DEFAULT' END AS label, CAST(day AS INTEGER) AS x,
  round(mean, 6) AS y FROM runs""",
    "metric_series_frequency": f"""WITH {_RUNS} SELECT 'Output frequency for all operators: ' ||
  CASE WHEN day % 5 < 3 THEN 2 ELSE 4 END AS label, CAST(day AS INTEGER) AS x,
  round(mean, 6) AS y FROM runs""",
    "metric_series_timer_nodes": f"""WITH {_RUNS} SELECT 'Timer nodes used: ' ||
  CASE WHEN day % 6 = 0 THEN 'T' ELSE 'NIL' END AS label, CAST(day AS INTEGER) AS x,
  round(mean, 6) AS y FROM runs""",
    "metric_scalability_latency": f"""WITH {_RUNS} SELECT event_type AS series,
  CAST(day AS INTEGER) AS x, round(mean, 6) AS y,
  round(first_value(mean) OVER (PARTITION BY event_type ORDER BY day) / mean, 6) AS scalability
  FROM runs""",
    "metric_efficiency_throughput": f"""WITH {_RUNS} SELECT event_type AS series,
  CAST(day AS INTEGER) AS x, round(mean, 6) AS y,
  round(mean / first_value(mean) OVER w / row_number() OVER w, 6) AS efficiency
  FROM runs WINDOW w AS (PARTITION BY event_type ORDER BY day)""",
    "metric_distribution_with_nulls": f"""WITH e AS (
  SELECT CASE WHEN event_type <> 'signup' THEN event_type END AS kind,
    CASE WHEN event_id % 7 > 0 AND event_type <> 'click' THEN value END AS value FROM events),
known AS (SELECT * FROM e WHERE value IS NOT NULL),
d AS ({_dist('kind', 'known')})
SELECT k.kind, coalesce(d.samples, 0) AS samples, d.mean, {', '.join(f'd.p{p}' for p in _P)}
FROM (SELECT DISTINCT kind FROM e) k LEFT JOIN d ON k.kind IS NOT DISTINCT FROM d.kind""",
    "latency_by_branch": f"""WITH {_LOG},
v AS ({_VOLUME}), s AS ({_STATUS}), g AS ({_GEO}),
b AS (SELECT 'Volume' AS tag, event_id FROM v UNION ALL SELECT 'Status', event_id FROM s
  UNION ALL SELECT 'Geo', event_id FROM g),
l AS (SELECT tag, CAST(round(e.value * 1e6) AS BIGINT) AS value FROM b JOIN events e USING (event_id)),
t AS (SELECT tag, value FROM l UNION ALL SELECT 'overall', value FROM l)
{_dist('tag', 't')}""",
    "metric_axis": f"""WITH {_RUNS} SELECT name, CAST(day AS INTEGER) AS day,
  round(mean * 1000000000, 6) AS per_second,
  CASE day % 3 WHEN 0 THEN 0 WHEN 1 THEN 16 ELSE 64 END AS x FROM runs""",
    "metric_scalability": f"""WITH {_RUNS} SELECT event_type AS series, CAST(day AS INTEGER) AS x,
  round(mean, 6) AS y, round(mean / first_value(mean) OVER (PARTITION BY event_type ORDER BY day),
  6) AS scalability FROM runs""",
    "metric_efficiency": f"""WITH {_RUNS} SELECT event_type AS series, CAST(day AS INTEGER) AS x,
  round(mean, 6) AS y, round(first_value(mean) OVER w / mean / row_number() OVER w, 6)
  AS efficiency FROM runs WINDOW w AS (PARTITION BY event_type ORDER BY day)""",
    "metric_ideal": f"""WITH {_RUNS}, n AS (SELECT max(c) AS n FROM (SELECT count(*) AS c FROM runs
  GROUP BY event_type))
SELECT 'Ideal' AS label, x, x AS y FROM (SELECT unnest(range(1, n + 1)) AS x FROM n)
UNION ALL SELECT 'Ideal efficiency', x, 1 FROM (SELECT unnest(range(1, n + 1)) AS x FROM n)""",
    "metric_box": f"""SELECT CAST(day AS INTEGER) AS day, substr(k, 2) || 'th percentile' AS percentile,
  v AS value FROM (UNPIVOT (SELECT day, p5, p25, p50, p75, p95 FROM ({_dist(
      'day', '(SELECT day(ts) AS day, value FROM events)')}))
  ON p5, p25, p50, p75, p95 INTO NAME k VALUE v)""",
    "metric_pivot": f"""WITH {_RUNS} SELECT CAST(day AS INTEGER) AS x, """ + ", ".join(
        f"round(max(mean) FILTER (event_type = '{s}'), 6) AS {s}"
        for s in ("click", "error", "purchase", "signup", "view")) + " FROM runs GROUP BY day",
    "fn_abs_diff": """SELECT event_id, round(abs(value - user_id), 6) AS diff FROM events""",
    "fn_split": """SELECT event_id, array_to_string(f, '|') AS parts, CAST(len(f) AS INTEGER) AS n
  FROM (SELECT event_id, list_filter(string_split(',' || event_type || ',,' ||
    CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END || ',' || props || ',',
    ','), lambda x: x <> '') AS f FROM events)""",
    "fn_int_list": """SELECT event_id, user_id || '|' || (event_id % 100) || '|7' AS ints,
  CAST(user_id + event_id % 100 + 7 AS INTEGER) AS total FROM events""",
    "fn_parse_bool": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false
  WHEN 2 THEN user_id % 3 > 0 ELSE false END AS flag FROM events""",
}
