"""The same results in SQL over the same tables, written from the definitions and not from the plans.

Windows are joined to the events inside them, statistics are computed from lists of values.
"""

from __future__ import annotations

from windrow.schema import FEATURES

_NOW = "TIMESTAMP '2024-01-29 12:00:00'"
_NOW_EPOCH = f"epoch({_NOW})"
_SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"
_F = ", ".join(FEATURES)
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES)

_EVENTS = """
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, printf('usr_%05d', user_id) AS user_id, props->>'$.k' AS session_id,
         CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart' WHEN 'purchase' THEN 'purchase'
                         WHEN 'signup' THEN 'search' WHEN 'error' THEN 'abandon' END AS event_type,
         ts AS "timestamp", CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS transaction_amount
  FROM events)"""

_REFERENCE = ("5 minutes", "1 hour", "30 minutes", "1 hour", "24 hours")
_DENSE = ("1 day", "7 days", "1 day", "1 day", "7 days")
_SKEWED = ("1 day", "3 days", "1 day", "1 day", "3 days")


def _vector(name: str, widths: tuple[str, ...], events: str = "ev") -> str:
    """CTEs ending in ``name``: the vectors, one join per window kind."""
    base, spend, carts, views, history = widths
    key = "b.user_id, b.s"

    def inside(kind: str, low: str, high: str) -> str:
        return f"""FROM {name}_base b JOIN {events} x ON x.user_id = b.user_id AND x.event_type IN ({kind})
          AND x."timestamp" >= {low} AND x."timestamp" < {high} GROUP BY {key}"""

    def last_closed(width: str) -> tuple[str, str]:
        end = f"time_bucket(INTERVAL '{width}', b.e)"
        return f"{end} - INTERVAL '{width}'", end

    return f"""
{name}_base AS (
  SELECT user_id, s, s + INTERVAL '{base}' AS e, count(*) FILTER (buys) AS n, avg(amount) AS avg_now,
         count(*) AS n_all, count(DISTINCT session_id) AS n_sessions
  FROM (SELECT user_id, time_bucket(INTERVAL '{base}', "timestamp") AS s, event_type = 'purchase' AS buys, session_id,
               CASE WHEN event_type = 'purchase' THEN transaction_amount END AS amount FROM {events})
  GROUP BY user_id, s HAVING count(*) FILTER (buys) > 0),
{name}_spend AS (
  SELECT {key}, avg(x.transaction_amount) AS v {inside("'purchase'", f"b.e - INTERVAL '{spend}'", "b.e")}),
{name}_hist AS (
  SELECT {key}, avg(x.transaction_amount) AS m, stddev_samp(x.transaction_amount) AS sd
  {inside("'purchase'", f"b.e - INTERVAL '{history}'", "b.e")}),
{name}_cart AS (
  SELECT {key}, count(*) FILTER (x.event_type = 'add_to_cart') AS c, count(*) FILTER (x.event_type = 'purchase') AS p
  {inside("'add_to_cart', 'purchase'", *last_closed(carts))}),
{name}_view AS (SELECT {key}, count(*) AS n {inside("'page_view'", *last_closed(views))}),
{name} AS (
  SELECT user_id, s AS window_start, e AS window_end, CAST(epoch(s) AS DOUBLE) AS computed_at,
         CAST(b.n AS DOUBLE) AS txn_count_5m, coalesce(sp.v, 0.0) AS avg_spend_1h,
         CASE WHEN n_sessions > 0 THEN n_all / n_sessions ELSE 0.0 END AS session_activity_rate,
         CASE WHEN c > 0 THEN greatest((c - p) / c, 0.0) ELSE 0.0 END AS cart_abandon_ratio,
         CAST(coalesce(v.n, 0) AS DOUBLE) AS product_interaction_freq,
         abs((avg_now - m) / (coalesce(sd, 1.0) + 1e-6)) AS anomaly_score
  FROM {name}_base b LEFT JOIN {name}_spend sp USING (user_id, s) LEFT JOIN {name}_hist h USING (user_id, s)
       LEFT JOIN {name}_cart ca USING (user_id, s) LEFT JOIN {name}_view v USING (user_id, s))"""


def _latest(name: str, of: str, where: str = "true", ttl: int | None = None) -> str:
    expiry = f", computed_at + {float(ttl)} AS expires_at" if ttl else ""
    return f"""
{name} AS (SELECT *{expiry} FROM {of} WHERE {where}
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY window_end DESC, computed_at DESC) = 1)"""


def _samples(widths: tuple[str, ...]) -> str:
    return f"""{_EVENTS}, {_vector("vec", widths)},
samples AS (SELECT feature_name, CASE WHEN window_start < {_SPLIT} THEN 'baseline' ELSE 'current' END AS side,
                   round(value, 9) AS value
            FROM (UNPIVOT vec ON {_F} INTO NAME feature_name VALUE value))"""


_ONLINE = f"{_EVENTS}, {_vector('vec', _REFERENCE)}, {_latest('online', 'vec', f'window_end <= {_NOW}', 2 * 86400)}"

# Statistics over ``samples`` -----------------------------------------------------------------------------

_SIDES = """
sides AS (
  SELECT feature_name, count(*) FILTER (side = 'baseline') AS nb, count(*) FILTER (side = 'current') AS nc,
         min(value) FILTER (side = 'baseline') AS lo, max(value) FILTER (side = 'baseline') AS hi,
         min(value) AS jlo, max(value) + 1e-9 AS jhi,
         avg(value) FILTER (side = 'baseline') AS mb, stddev_pop(value) FILTER (side = 'baseline') + 1e-6 AS sb,
         avg(value) FILTER (side = 'current') AS mc
  FROM samples GROUP BY feature_name),
bins AS (SELECT CAST(unnest(range(0, 10)) AS DOUBLE) AS i)"""

_PSI = f"""{_SIDES},
psi_counts AS (
  SELECT feature_name, i, any_value(nb) AS nb, any_value(nc) AS nc, any_value(lo) AS lo, any_value(hi) AS hi,
         count(*) FILTER (side = 'baseline' AND inside) AS b, count(*) FILTER (side = 'current' AND inside) AS c
  FROM (SELECT s.*, g.* EXCLUDE (feature_name), i,
               value >= i * ((hi - lo) / 10.0) + lo
               AND CASE WHEN i = 9 THEN value <= hi + 1e-6 ELSE value < (i + 1) * ((hi - lo) / 10.0) + lo END AS inside
        FROM samples s JOIN sides g USING (feature_name) CROSS JOIN bins)
  GROUP BY feature_name, i),
psi_shares AS (
  SELECT feature_name, nb, nc, lo, hi, CASE WHEN b = 0 THEN 1e-6 ELSE b / (nb + 1e-6) END AS p,
         CASE WHEN c = 0 THEN 1e-6 ELSE c / (nc + 1e-6) END AS q FROM psi_counts),
psi AS (
  SELECT feature_name,
         CASE WHEN min(nb) > 0 AND min(nc) > 0 AND min(lo) < min(hi)
              THEN round(greatest(sum((q - p) * ln(q / p)), 0.0), 6) ELSE 0.0 END AS psi_score
  FROM psi_shares GROUP BY feature_name)"""

_KL = """
kl_counts AS (
  SELECT feature_name, i, any_value(jhi - jlo) / 10.0 AS width, any_value(nb) AS nb, any_value(nc) AS nc,
         any_value(jlo) < any_value(jhi) - 1e-9 AS spread,
         count(*) FILTER (side = 'baseline' AND inside) AS b, count(*) FILTER (side = 'current' AND inside) AS c
  FROM (SELECT s.*, g.* EXCLUDE (feature_name), i,
               value >= i * ((jhi - jlo) / 10.0) + jlo
               AND (i = 9 OR value < (i + 1) * ((jhi - jlo) / 10.0) + jlo) AS inside
        FROM samples s JOIN sides g USING (feature_name) CROSS JOIN bins)
  GROUP BY feature_name, i),
kl_density AS (SELECT *, b / nb / width + 1e-10 AS p, c / nc / width + 1e-10 AS q FROM kl_counts),
kl_share AS (SELECT feature_name, spread, nb, nc, p / sum(p) OVER f AS p, q / sum(q) OVER f AS q
             FROM kl_density WINDOW f AS (PARTITION BY feature_name)),
kl AS (SELECT feature_name, CASE WHEN bool_and(spread) AND min(nb) > 0 AND min(nc) > 0
                                 THEN sum(p * ln(p / q)) ELSE 0.0 END AS kl_divergence
       FROM kl_share GROUP BY feature_name)"""

_Z = """
z AS (
  SELECT feature_name, round(mc, 4) AS current_mean, round(mb, 4) AS baseline_mean, round(sb, 4) AS baseline_std,
         round(abs(mc - mb) / sb, 4) AS z_score, abs(mc - mb) / sb > 3.0 AS is_anomalous FROM sides)"""

_KS = """
steps AS (
  SELECT DISTINCT feature_name,
         (count(*) FILTER (side = 'baseline') OVER w) / nb - (count(*) FILTER (side = 'current') OVER w) / nc AS gap, value
  FROM samples JOIN sides USING (feature_name)
  WINDOW w AS (PARTITION BY feature_name ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks_d AS (SELECT feature_name, max(abs(gap)) AS d FROM steps GROUP BY feature_name),
ks_x AS (SELECT feature_name, d, round(CAST(nb AS DOUBLE) * nc / (nb + nc)) AS en FROM ks_d JOIN sides USING (feature_name)),
ks_arg AS (SELECT feature_name, d, sqrt(en) * d + 1 / (6 * sqrt(en)) + (sqrt(en) * d - 1) / (4 * en) AS x FROM ks_x),
ks_raw AS (
  SELECT feature_name, d, CASE WHEN d <= 0 OR x < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(
           range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * x * x))), 0.0), 1.0) END AS p
  FROM ks_arg),
ks AS (SELECT feature_name, round(d, 6) AS ks_statistic, round(p, 6) AS ks_p_value, p < 0.05 AS ks_significant FROM ks_raw)"""

_DRIFT = f"""{_PSI}, {_KL}, {_Z}, {_KS},
drift AS (
  SELECT *, severity <> 'ok' AS is_drifting
  FROM (SELECT feature_name, psi_score, ks_statistic, ks_p_value, ks_significant, current_mean, baseline_mean, baseline_std,
               z_score, is_anomalous, round(kl_divergence, 6) AS kl_divergence, nb AS baseline_size, nc AS current_size,
               false AS baseline_missing,
               CASE WHEN psi_score >= 0.2 THEN 'alert' WHEN psi_score >= 0.1 OR ks_significant THEN 'warn' ELSE 'ok' END AS severity
        FROM psi JOIN kl USING (feature_name) JOIN z USING (feature_name) JOIN ks USING (feature_name)
             JOIN sides USING (feature_name)))"""


def _with_drift(widths: tuple[str, ...]) -> str:
    return f"WITH {_samples(widths)}, {_DRIFT}"


# Feature windows -----------------------------------------------------------------------------------------


def _tumbling_pair(name: str, column: str, where: str, value: str, reference: str) -> dict[str, str]:
    return {
        name: _grouped(reference, where, value, column),
        f"{name}_dense": _grouped("1 day", where, value, column),
    }


def _grouped(width: str, where: str, value: str, column: str) -> str:
    return f"""WITH {_EVENTS},
b AS (SELECT *, time_bucket(INTERVAL '{width}', "timestamp") AS s FROM ev WHERE {where})
SELECT user_id, s AS window_start, s + INTERVAL '{width}' AS window_end, round(CAST({value} AS DOUBLE), 6) AS {column}
FROM b GROUP BY user_id, s"""


def _sliding(width: str, slide: str) -> str:
    return f"""WITH {_EVENTS},
w AS (SELECT user_id, transaction_amount,
             unnest(generate_series(time_bucket(INTERVAL '{slide}', "timestamp") - INTERVAL '{width}' + INTERVAL '{slide}',
                                    time_bucket(INTERVAL '{slide}', "timestamp"), INTERVAL '{slide}')) AS s
      FROM ev WHERE event_type = 'purchase')
SELECT user_id, s AS window_start, s + INTERVAL '{width}' AS window_end, round(avg(transaction_amount), 6) AS avg_spend_1h
FROM w GROUP BY user_id, s"""


def _vector_query(widths: tuple[str, ...], select: str, tail: str = "") -> str:
    return f"WITH {_EVENTS}, {_vector('vec', widths)} SELECT {select} FROM vec {tail}"


_VECTOR_COLUMNS = f"user_id, window_start, window_end, computed_at, {_ROUNDED}"
_CARTS, _BUYS = "count(*) FILTER (event_type = 'add_to_cart')", "count(*) FILTER (event_type = 'purchase')"


def _feature_sql() -> dict[str, str]:
    found = {
        **_tumbling_pair("txn_count", "txn_count_5m", "event_type = 'purchase'", "count(*)", "5 minutes"),
        **_tumbling_pair(
            "session_activity_rate", "session_activity_rate", "true", "count(*) / count(DISTINCT session_id)", "5 minutes"
        ),
        **_tumbling_pair(
            "cart_abandon_ratio",
            "cart_abandon_ratio",
            "event_type IN ('add_to_cart', 'purchase')",
            f"CASE WHEN {_CARTS} > 0 THEN greatest(({_CARTS} - {_BUYS}) / {_CARTS}, 0.0) ELSE 0.0 END",
            "30 minutes",
        ),
        **_tumbling_pair(
            "product_interaction_freq", "product_interaction_freq", "event_type = 'page_view'", "count(*)", "1 hour"
        ),
        "avg_spend": _sliding("1 hour", "5 minutes"),
        "avg_spend_dense": _sliding("7 days", "1 day"),
    }
    score = "user_id, window_start, window_end, round(anomaly_score, 6) AS anomaly_score"
    found["anomaly_score"] = _vector_query(_REFERENCE, score)
    found["anomaly_score_dense"] = _vector_query(_DENSE, score)
    found["feature_vector"] = _vector_query(_REFERENCE, _VECTOR_COLUMNS)
    found["feature_vector_dense"] = _vector_query(_DENSE, _VECTOR_COLUMNS)
    until = """till AS (SELECT * FROM ev WHERE "timestamp" <= TIMESTAMP '2024-01-20')"""
    in_range = "WHERE window_start BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"
    at_now = f"user_id, window_start, window_end, CAST({_NOW_EPOCH} AS DOUBLE) AS computed_at, {_ROUNDED}"
    found["backfill_vector"] = (
        f"WITH {_EVENTS}, {until}, {_vector('vec', _REFERENCE, 'till')} SELECT {at_now} FROM vec {in_range}"
    )
    found["backfill_vector_dense"] = (
        f"WITH {_EVENTS}, {until}, {_vector('vec', _DENSE, 'till')} SELECT {_VECTOR_COLUMNS} FROM vec {in_range}"
    )
    cells = f"""WITH {_EVENTS},
b AS (SELECT *, time_bucket(INTERVAL '1 day', "timestamp") AS s,
             CASE WHEN event_type = 'purchase' THEN transaction_amount END AS amount FROM ev)
SELECT user_id, s AS window_start, s + INTERVAL '1 day' AS window_end, count(*) AS n_events, {_BUYS} AS n_purchases,
       {_CARTS} AS n_carts, count(*) FILTER (event_type = 'page_view') AS n_views, count(amount) AS n_amounts,
       round(coalesce(sum(amount), 0.0), 6) AS sum_amount,
       round(coalesce(var_pop(amount) * count(amount), 0.0), 6) AS m2_amount, count(DISTINCT session_id) AS n_sessions
FROM b GROUP BY user_id, s"""
    found["base_cells"] = found["base_cells_from_sessions"] = cells
    return found


_RECORDS = f"""{_EVENTS},
who AS (SELECT printf('usr_%05d', c_custkey) AS user_id, n_name AS country, c_name AS city,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'mobile' WHEN 'AUTOMOBILE' THEN 'desktop'
                                 WHEN 'MACHINERY' THEN 'tablet' WHEN 'HOUSEHOLD' THEN 'tv' END AS device_type
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
rec AS (SELECT ev.*, who.* EXCLUDE (user_id), who.user_id IS NOT NULL AS placed FROM ev LEFT JOIN who USING (user_id)),
checked AS (
  SELECT *, concat_ws('; ', CASE WHEN session_id IS NULL THEN 'session_id is missing' END,
                      CASE WHEN NOT placed THEN 'location is missing' END,
                      CASE WHEN country IS NULL THEN 'location.country is missing' END,
                      CASE WHEN city IS NULL THEN 'location.city is missing' END,
                      CASE WHEN device_type IS NULL THEN 'device_type is missing' END,
                      CASE WHEN device_type = 'tv' THEN 'device_type is unknown' END) AS reject_reasons FROM rec)"""

_EVENT_COLUMNS = 'event_id, user_id, session_id, event_type, "timestamp", transaction_amount'


def _held_and_batch() -> str:
    return f"""{_EVENTS}, {_vector('a', _DENSE)}, {_vector('b', _SKEWED)},
held AS (SELECT * FROM a WHERE window_start < {_SPLIT}),
batch AS (SELECT * REPLACE (computed_at + 60.0 AS computed_at) FROM b WHERE window_start >= TIMESTAMP '2024-01-10'),
merged AS (SELECT * FROM (FROM held UNION ALL BY NAME FROM batch)
           QUALIFY row_number() OVER (PARTITION BY user_id, window_start ORDER BY computed_at DESC) = 1)"""


def _sessions(gap: str) -> str:
    return f"""WITH {_EVENTS},
marked AS (SELECT *, coalesce("timestamp" > lag("timestamp") OVER u + INTERVAL '{gap}', true) AS begins
           FROM ev WINDOW u AS (PARTITION BY user_id ORDER BY "timestamp")),
numbered AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY user_id ORDER BY "timestamp") AS n FROM marked)
SELECT user_id, min("timestamp") AS session_start, max("timestamp") + INTERVAL '{gap}' AS session_end, count(*) AS n_events,
       {_BUYS} AS n_purchases FROM numbered GROUP BY user_id, n"""


def _source_sql() -> dict[str, str]:
    return {
        "parse_events": f"WITH {_EVENTS} SELECT {_EVENT_COLUMNS} FROM ev",
        "rescued_events": f"""WITH {_EVENTS},
r AS (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev),
ok AS (SELECT *, n % 13 <> 0 OR n % 11 = 0 AS whole FROM r)
SELECT CASE WHEN whole THEN event_id END AS event_id, CASE WHEN whole THEN user_id END AS user_id,
  CASE WHEN whole AND n % 5 <> 0 THEN 2.5::DOUBLE END AS transaction_amount,
  CASE WHEN whole AND n % 4 = 0 THEN 'A' END AS city,
  CASE WHEN whole THEN CAST(epoch_us("timestamp") AS VARCHAR) END AS micros,
  CASE WHEN NOT whole THEN '$'
    ELSE nullif(array_to_string(list_sort(list_filter([
      CASE WHEN n % 3 = 0 THEN 'coupon={{"code":"X","off":5}}' END,
      CASE WHEN n % 4 = 0 THEN 'location.zip=12' WHEN n % 4 = 1 THEN 'location="US"' END,
      CASE WHEN n % 5 = 0 THEN 'transaction_amount="about ten"' END], lambda x: x IS NOT NULL)), ';'), '') END AS rescued
FROM ok""",
        "validate_events": f"""WITH {_RECORDS}
SELECT event_id, user_id, event_type, country, device_type, '1.0' AS schema_version FROM checked WHERE reject_reasons = ''""",
        "rejected_events": f"WITH {_RECORDS} SELECT event_id, reject_reasons FROM checked WHERE reject_reasons <> ''",
        "event_history": f"""WITH {_EVENTS} SELECT {_EVENT_COLUMNS} FROM ev
WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20 12:00:00'""",
        "partition_columns": _vector_query(
            _REFERENCE, "user_id, window_start, strftime(window_start, '%Y-%m-%d') AS event_date, user_id[1:3] AS user_prefix"
        ),
        "partition_filter": _vector_query(
            _REFERENCE, f"user_id, window_start, {_ROUNDED}", "WHERE CAST(window_start AS DATE) = DATE '2024-01-12'"
        ),
        "upsert_vectors": f"WITH {_held_and_batch()} SELECT {_VECTOR_COLUMNS} FROM merged",
        "dedup_events": f"WITH {_EVENTS} SELECT {_EVENT_COLUMNS} FROM ev",
        "sessions": _sessions("30 minutes"),
        "sessions_daily": _sessions("1 day"),
    }


_FILLED_FROM, _FILLED_TO = "TIMESTAMP '2024-01-12 00:00:00'", "TIMESTAMP '2024-01-20 12:00:00'"


def _store_sql() -> dict[str, str]:
    day = "strftime(window_start, '%Y-%m-%d') AS event_date"
    online = f"{_VECTOR_COLUMNS}, expires_at"
    streamed = f"user_id, window_start, window_end, CAST({_NOW_EPOCH} AS DOUBLE) AS computed_at, {_ROUNDED}"
    return {
        "history_at_version": f"WITH {_held_and_batch()} SELECT {_VECTOR_COLUMNS}, {day} FROM held",
        "history_as_of": f"WITH {_held_and_batch()} SELECT user_id, {_ROUNDED}, computed_at, {day} FROM merged",
        "history_compacted": f"WITH {_held_and_batch()} SELECT {_VECTOR_COLUMNS}, {day} FROM merged",
        "online_after_batches": f"""WITH {_EVENTS}, {_vector('vec', _REFERENCE)}, {_latest('online', 'vec', ttl=2 * 86400)}
SELECT {online} FROM online""",
        # Append mode emits windows that end at or before the watermark, ten minutes behind the last event.
        "streamed_history": _vector_query(
            _REFERENCE, streamed, """WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'"""
        ),
        "streamed_online": f"""WITH {_EVENTS}, {_vector('vec', _REFERENCE)}, {_latest('online', 'vec')}
SELECT {streamed}, CAST({_NOW_EPOCH} + 300 AS DOUBLE) AS expires_at FROM online""",
        # Inside the range the backfill's vectors count, elsewhere those of the stream.
        "history_after_backfill_and_stream": f"""WITH {_EVENTS}, {_vector('vec', _REFERENCE)},
till AS (SELECT * FROM ev WHERE "timestamp" <= {_FILLED_TO}), {_vector('fill', _REFERENCE, 'till')}
SELECT {streamed} FROM vec WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'
  AND window_start NOT BETWEEN {_FILLED_FROM} AND {_FILLED_TO}
UNION ALL BY NAME
SELECT user_id, window_start, window_end, CAST(1 AS DOUBLE) AS computed_at, {_ROUNDED} FROM fill
WHERE window_start BETWEEN {_FILLED_FROM} AND {_FILLED_TO}""",
        "serve_from_store": f"""WITH {_ONLINE}
SELECT u.user_id, o.user_id IS NOT NULL AS found, {", ".join(f"round(coalesce(o.{c}, 0.0), 6) AS {c}" for c in FEATURES)},
       o.computed_at, round({_NOW_EPOCH} - o.computed_at, 1) AS freshness_seconds, 'online_store' AS source,
       '1.0' AS schema_version
FROM (SELECT printf('usr_%05d', c_custkey) AS user_id FROM customer) u
     LEFT JOIN (SELECT * FROM online WHERE expires_at > {_NOW_EPOCH}) o USING (user_id)""",
        "refresh_features": f"""WITH {_EVENTS}, {_vector('vec', _REFERENCE)},
{_latest('early', 'vec', f'window_start < {_SPLIT}', 2 * 86400)}, {_latest('later', 'vec', ttl=300)},
stale AS (SELECT user_id FROM early WHERE floor(expires_at - epoch({_SPLIT})) BETWEEN 1 AND 86399)
SELECT {online} FROM early WHERE user_id NOT IN (FROM stale)
UNION ALL BY NAME
SELECT {online} FROM later WHERE user_id IN (FROM stale)""",
        "verify_backfill": f"""WITH {_EVENTS},
a AS (SELECT * FROM ev WHERE "timestamp" <= TIMESTAMP '2024-01-15 12:00:00'), {_vector('one', _REFERENCE, 'a')},
b AS (SELECT * FROM ev WHERE "timestamp" <= TIMESTAMP '2024-01-17'), {_vector('two', _REFERENCE, 'b')},
stored AS (SELECT user_id, window_start, {_ROUNDED} FROM one
           WHERE window_start BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-15 12:00:00'),
expected AS (SELECT user_id, window_start, {_ROUNDED} FROM two
             WHERE window_start BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-17'),
side AS (SELECT 'stored' AS name, window_start FROM stored UNION ALL SELECT 'expected', window_start FROM expected
  UNION ALL SELECT 'missing', window_start FROM (FROM expected EXCEPT ALL FROM stored)
  UNION ALL SELECT 'unexpected', window_start FROM (FROM stored EXCEPT ALL FROM expected)),
per_day AS (SELECT strftime(window_start, '%Y-%m-%d') AS event_date, count(*) FILTER (name = 'stored') AS stored,
  count(*) FILTER (name = 'expected') AS expected, count(*) FILTER (name = 'missing') AS missing,
  count(*) FILTER (name = 'unexpected') AS unexpected FROM side GROUP BY 1)
SELECT *, missing = 0 AND unexpected = 0 AS agrees FROM per_day""",
        # The state's watermark ends ten minutes behind the last window.
        "streamed_current": f"""WITH {_EVENTS}, {_vector('vec', _REFERENCE)}, {_latest('online', 'vec', ttl=2 * 86400)}
SELECT user_id, window_end, computed_at, expires_at, {_ROUNDED} FROM online
WHERE expires_at > (SELECT epoch(max(window_end) - INTERVAL '10 minutes') FROM vec)""",
        "admitted_batches": """WITH c AS (SELECT count(*) AS n, count(*) // 6 + 1 AS most FROM events)
SELECT b AS batch, CAST(least(most, n - b * most) AS BIGINT) AS n_rows FROM c, range(6) AS r(b) WHERE n > b * most""",
        "keyed_activity": f"""WITH {_EVENTS}
SELECT user_id, event_id, "timestamp", event_type FROM ev
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, event_id DESC, event_type DESC) = 1""",
        "check_consistency": f"""WITH {_EVENTS}, {_vector('a', _DENSE)}, {_vector('b', _SKEWED)},
{_latest('served', 'b', f"window_end <= {_NOW} AND computed_at + 300 > {_NOW_EPOCH} - 172500")},
offline AS (SELECT a.* FROM a JOIN served s USING (user_id, window_start)), {_compared('served')}, {_REPORT}
SELECT * EXCLUDE (severity) FROM report""",
        "logged_metrics": f"""WITH {_EVENTS}, {_vector('vec', _DENSE)},
{_latest('early', 'vec', f'window_start < {_SPLIT}')}, {_latest('whole', 'vec')},
samples AS (SELECT feature_name, 'baseline' AS side, round(value, 9) AS value FROM (UNPIVOT early ON {_F} INTO NAME feature_name VALUE value)
            UNION ALL SELECT feature_name, 'current', round(value, 9) FROM (UNPIVOT whole ON {_F} INTO NAME feature_name VALUE value)),
{_DRIFT}
SELECT feature_name, 'psi_score' AS metric_type, psi_score AS metric_value, CAST({_NOW_EPOCH} AS BIGINT) AS recorded_at FROM drift
UNION ALL
SELECT feature_name, 'ks_statistic', ks_statistic, CAST({_NOW_EPOCH} AS BIGINT) FROM drift""",
        "recent_diagnoses": f"""{_with_drift(_REFERENCE)}
SELECT feature_name, probable_cause, cause_category, confidence, urgency, CAST({_NOW_EPOCH} AS BIGINT) AS computed_at
FROM ({_diagnosed('drift')})""",
    }


def _as_of(widths: tuple[str, ...], max_age: str = "") -> str:
    kept = "true" if not max_age else f"label_ts - window_end < INTERVAL '{max_age}' + INTERVAL '1 second'"
    columns = ["window_start", "window_end", "computed_at", *FEATURES]
    chosen = ", ".join(
        f"CASE WHEN {kept} THEN {f'round({c}, 6)' if c in FEATURES else c} END AS {c}" for c in columns
    )
    return f"""WITH {_EVENTS}, {_vector('vec', widths)},
labels AS (SELECT event_id, user_id, "timestamp" AS label_ts FROM ev WHERE event_type = 'search')
SELECT l.event_id, l.user_id, l.label_ts, {chosen}
FROM labels l ASOF LEFT JOIN vec v ON l.user_id = v.user_id AND l.label_ts >= v.window_end"""


def _user_sql() -> dict[str, str]:
    day = "strftime(window_start, '%Y-%m-%d') AS event_date"

    def newest(widths: tuple[str, ...]) -> str:
        return f"WITH {_EVENTS}, {_vector('vec', widths)}, {_latest('l', 'vec')} SELECT {_VECTOR_COLUMNS} FROM l"

    return {
        "latest_vector": newest(_REFERENCE),
        "latest_vector_dense": newest(_DENSE),
        "sample_users": f"WITH {_EVENTS} SELECT DISTINCT user_id FROM ev ORDER BY md5('7:' || user_id), user_id LIMIT 50",
        "active_users": f"WITH {_EVENTS} SELECT count(DISTINCT user_id) AS active_users FROM ev",
        "cohort_training_rows": _vector_query(
            _DENSE,
            f"user_id, {_ROUNDED}, computed_at, {day}",
            "WHERE user_id IN (SELECT printf('usr_%05d', c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')",
        ),
        "point_in_time": _as_of(_REFERENCE),
        "point_in_time_max_age": _as_of(_REFERENCE, "2 days"),
        "point_in_time_dense": _as_of(_DENSE),
    }


def _histogram(n_bins: int, counts: str) -> str:
    return f"""WITH {_samples(_DENSE)},
e AS (SELECT feature_name, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
             CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM samples GROUP BY 1),
g AS (SELECT *, (hi - lo) / {float(n_bins)} AS w, unnest(range(1, {n_bins + 1})) AS bin FROM e)
SELECT feature_name, CAST(bin AS INTEGER) AS bin, round(any_value(lo + (bin - 1) * w), 6) AS lower,
       round(any_value(lo + bin * w), 6) AS upper, {counts}
FROM g LEFT JOIN samples s ON s.feature_name = g.feature_name AND s.value >= lo + (bin - 1) * w
     AND (bin = {n_bins} OR s.value < lo + bin * w)
GROUP BY g.feature_name, bin""".replace("SELECT feature_name, CAST(bin", "SELECT g.feature_name, CAST(bin")


def _drift_sql() -> dict[str, str]:
    both = "count(value) FILTER (side = 'baseline') AS n_baseline, count(value) FILTER (side = 'current') AS n_current"
    reading = """CASE WHEN psi_score < 0.1 THEN 'no significant shift' WHEN psi_score < 0.2
       THEN 'moderate shift — monitor closely' ELSE 'major shift — investigate immediately' END AS psi_interpretation"""
    level = "CASE WHEN psi_score < 0.1 THEN 'ok' WHEN psi_score < 0.2 THEN 'warn' ELSE 'alert' END AS severity"
    kept = ", ".join(f"'{f}'" for f in FEATURES[:3])
    alone = _with_drift(_DENSE).replace(
        "SELECT feature_name, CASE WHEN window_start <",
        f"""SELECT * FROM (SELECT feature_name, round(value, 9) AS value, unnest(CASE WHEN feature_name IN ({kept})
              THEN [CASE WHEN window_start < {_SPLIT} THEN 'baseline' ELSE 'current' END]
              WHEN window_start >= {_SPLIT} THEN ['baseline', 'current'] ELSE [] END) AS side
            FROM (UNPIVOT vec ON {_F} INTO NAME feature_name VALUE value))), samples_unused AS (
            SELECT feature_name, CASE WHEN window_start <""",
    )
    return {
        "psi": f"WITH {_samples(_REFERENCE)}, {_PSI} SELECT * FROM psi",
        "psi_dense": f"WITH {_samples(_DENSE)}, {_PSI} SELECT * FROM psi",
        "psi_severity": f"WITH {_samples(_DENSE)}, {_PSI} SELECT feature_name, {level}, {reading} FROM psi",
        # Lattice paths that stay below the gap, a diagonal at a time, at the points that lie inside.
        "ks_2samp_exact": f"""WITH RECURSIVE {_samples(_DENSE)}, {_SIDES}, {_KS},
walk AS (
  SELECT feature_name, nb, nc, CAST(round(d * nb * nc) AS BIGINT) AS reach, 0 AS length, 0 AS low, [1::DOUBLE] AS inside
  FROM ks_raw JOIN sides USING (feature_name)
  UNION ALL
  SELECT feature_name, nb, nc, reach, length, first, list_transform(range(first, past), lambda i:
    CASE WHEN i < low OR i - low >= len(inside) THEN 0 ELSE inside[i - low + 1] END * ((length - i) / length)
    + CASE WHEN i - 1 < low OR i - 1 - low >= len(inside) THEN 0 ELSE inside[i - low] END * (i / length))
  FROM (SELECT * EXCLUDE (length), length + 1 AS length,
          greatest(0, length + 1 - nc, CAST(floor(((length + 1) * nb - reach) / (nb + nc)) AS BIGINT) + 1) AS first,
          least(nb + 1, length + 2, CAST(ceil(((length + 1) * nb + reach) / (nb + nc)) AS BIGINT)) AS past
        FROM walk WHERE length < nb + nc))
SELECT feature_name, ks_statistic,
       CASE WHEN reach <= 0 THEN 1.0 ELSE round(least(greatest(1 - coalesce(inside[nb - low + 1], 0), 0), 1), 6) END AS ks_p_value
FROM walk JOIN ks USING (feature_name) WHERE length = nb + nc""",
        "sketched_summary": f"""WITH {_samples(_DENSE)}
SELECT feature_name, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max,
       true AS p25_within, true AS p50_within, true AS p75_within, true AS p95_within, true AS p99_within
FROM samples GROUP BY feature_name""",
        "weekly_users": """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users, count(*) AS events
FROM days JOIN events ON CAST(ts AS DATE) BETWEEN day - 6 AND day GROUP BY day""",
        "drift_levels": f"""WITH {_samples(_DENSE)}
SELECT feature_name, side, grouping_id(feature_name, side) AS level, count(value) AS n, count(*) FILTER (value = 0) AS zeros,
       round(min(value), 6) AS low, round(max(value), 6) AS high,
       round(count(*) FILTER (value = 0) / count(value), 6) AS zero_share
FROM samples GROUP BY CUBE (feature_name, side)""",
        "ks_2samp": f"WITH {_samples(_DENSE)}, {_SIDES}, {_KS} SELECT * FROM ks",
        "z_score": f"WITH {_samples(_DENSE)}, {_SIDES}, {_Z} SELECT * FROM z",
        "kl_divergence": f"""WITH {_samples(_DENSE)}, {_SIDES}, {_KL}
SELECT feature_name, round(kl_divergence, 6) AS kl_divergence FROM kl""",
        "detect_drift": f"{_with_drift(_DENSE)} SELECT * FROM drift",
        "detect_drift_missing_baseline": f"""{alone}
SELECT * REPLACE (feature_name NOT IN ({kept}) AS baseline_missing) FROM drift""",
        "drift_verdict": f"""{_with_drift(_DENSE)}
SELECT count(*) AS features, count(*) FILTER (is_drifting) AS drifting,
       bool_or(severity = 'alert') AS has_critical_drift FROM drift""",
        "wide_to_long": f"""WITH {_EVENTS}, {_vector('vec', _REFERENCE)}
SELECT user_id, window_start, feature_name, round(value, 6) AS value
FROM (UNPIVOT vec ON {_F} INTO NAME feature_name VALUE value)""",
        "histogram": _histogram(30, "count(value) AS n"),
        "histogram_two_sided": _histogram(20, both),
        "feature_summary": f"""WITH {_samples(_DENSE)}
SELECT feature_name, count(*) AS n, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS std,
       round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, round(max(value), 3) AS max
FROM samples GROUP BY feature_name""",
        "box_stats": f"""WITH {_samples(_DENSE)}
SELECT feature_name, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
       round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max
FROM samples GROUP BY feature_name""",
    }


def _compared(online: str) -> str:
    dev = ", ".join(
        f"abs(f.{c} - coalesce(o.{c}, 0.0)) / (abs(f.{c}) + 1e-6) AS {c}" for c in FEATURES
    )
    return f"compared AS (SELECT f.user_id, {dev} FROM offline f LEFT JOIN {online} o USING (user_id))"


def _report(widths: tuple[str, ...]) -> str:
    return f"""WITH {_EVENTS}, {_vector('a', _DENSE)}, {_vector('b', widths)}, {_latest('offline', 'a')}, {_latest('served', 'b')},
{_compared('served')}, {_REPORT}"""


_MEANS = ", ".join(f"round(coalesce(avg({c}), 0.0), 6) AS dev_{c}" for c in FEATURES)
_DEVIATIONS = ", ".join(f"dev_{c}" for c in FEATURES)
_WORST = " ".join(f"WHEN dev_{c} = max_deviation THEN '{c}'" for c in FEATURES)
_REPORT = f"""
sums AS (SELECT count(*) AS sample_size, count(*) FILTER (greatest({_F}) > 0.01) AS inconsistent_users, {_MEANS} FROM compared),
report AS (
  SELECT sample_size, sample_size - inconsistent_users AS consistent_users, inconsistent_users,
         round(inconsistent_users / greatest(sample_size, 1), 6) AS inconsistency_rate, {_DEVIATIONS},
         greatest({_DEVIATIONS}) AS max_deviation, CASE {_WORST} END AS worst_feature,
         round(inconsistent_users / greatest(sample_size, 1), 6) <= 0.01 AS is_healthy,
         CASE WHEN round(inconsistent_users / sample_size, 6) > 0.10 THEN 'critical'
              WHEN round(inconsistent_users / sample_size, 6) > 0.05 THEN 'high'
              WHEN round(inconsistent_users / sample_size, 6) > 0.02 THEN 'medium'
              WHEN inconsistent_users > 0 THEN 'low' ELSE 'none' END AS severity
  FROM sums)"""


def _consistency_sql() -> dict[str, str]:
    per_user = ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES)
    return {
        "relative_deviation": f"""WITH {_EVENTS}, {_vector('a', _DENSE)}, {_vector('b', _SKEWED)}, {_latest('offline', 'a')},
{_latest('served', 'b', f'window_end <= {_NOW}')}, {_compared('served')} SELECT user_id, {per_user} FROM compared""",
        "consistency": f"{_report(_SKEWED)} SELECT * EXCLUDE (severity) FROM report",
        "consistency_healthy": f"{_report(_DENSE)} SELECT * EXCLUDE (severity) FROM report",
        "skew_severity": f"{_report(_SKEWED)} SELECT inconsistency_rate, severity FROM report",
        "skew_alert": f"""{_report(_SKEWED)}
SELECT 'skew_alert' AS key, 'training_serving_skew' AS alert_type, severity, inconsistency_rate, worst_feature,
       max_deviation, sample_size, CAST({_NOW_EPOCH} AS DOUBLE) AS timestamp FROM report WHERE severity <> 'none'""",
        "consistency_follow_up": f"""{_report(_SKEWED)}
SELECT worst_feature AS feature_name, inconsistency_rate, max_deviation FROM report WHERE inconsistency_rate > 0.05""",
    }


_SEEDS = """seeds AS (SELECT * FROM (VALUES
  ('txn_count_5m', 'tumbling_5m', 60, 'ml-platform', 'filter event_type=purchase', 'count_window_5m'),
  ('avg_spend_1h', 'sliding_1h', 300, 'ml-platform', 'filter event_type=purchase', 'avg_window_1h'),
  ('session_activity_rate', 'tumbling_5m', 60, 'ml-platform', 'all_events', 'session_rate_5m'),
  ('cart_abandon_ratio', 'tumbling_30m', 300, 'ml-platform', 'filter add_to_cart + purchase', 'cart_abandon_30m'),
  ('product_interaction_freq', 'tumbling_1h', 300, 'ml-platform', 'filter page_view', 'pageview_count_1h'),
  ('anomaly_score', 'tumbling_5m', 60, 'fraud-detection', 'filter purchase', 'zscore_24h'))
  t(feature_name, window_type, freshness_sla_seconds, owner, step_1, step_2))"""


def _serving_sql() -> dict[str, str]:
    def served(value, metadata: bool) -> str:
        columns = ", ".join(f"round(coalesce({value(c)}, 0.0), 6) AS {c}" for c in FEATURES)
        at = "o.computed_at" if metadata else "CAST(NULL AS DOUBLE)"
        age = f"round({_NOW_EPOCH} - o.computed_at, 1)" if metadata else "CAST(NULL AS DOUBLE)"
        return f"""WITH {_ONLINE}
SELECT u.user_id, o.user_id IS NOT NULL AS found, {columns}, {at} AS computed_at, {age} AS freshness_seconds,
       'online_store' AS source, '1.0' AS schema_version
FROM (SELECT printf('usr_%05d', c_custkey) AS user_id FROM customer) u
     LEFT JOIN (SELECT * FROM online WHERE expires_at > {_NOW_EPOCH}) o USING (user_id)"""

    ages = f"WITH {_ONLINE}, ages AS (SELECT user_id, round({_NOW_EPOCH} - computed_at, 1) AS freshness_seconds FROM online)"
    ttl = f"ttls AS (SELECT user_id, CAST(floor(expires_at - {_NOW_EPOCH}) AS BIGINT) AS ttl FROM online)"
    width = {"1 hour": 3600.0, "1 day": 86400.0}

    def throughput(w: str) -> str:
        return f"""WITH {_EVENTS}
SELECT time_bucket(INTERVAL '{w}', "timestamp") AS window_start, count(*) AS events, count(DISTINCT user_id) AS active_users,
       round(count(*) / {width[w]}, 6) AS events_per_sec,
       round(least(count(DISTINCT user_id) * 0.1::DOUBLE, 500.0), 6) AS estimated_events_per_sec
FROM ev GROUP BY 1"""

    metrics = """metrics AS (
  SELECT event_type AS feature_name, CASE WHEN value < 30 THEN 'psi_score' WHEN value < 60 THEN 'ks_statistic'
         WHEN value < 90 THEN 'null_rate' ELSE 'consistency_rate' END AS metric_type, value AS metric_value, ts AS recorded_at
  FROM events)"""
    return {
        "serve_features": served(lambda c: f"o.{c}", True),
        "serve_requested_features": served(
            lambda c: f"o.{c}" if c in ("avg_spend_1h", "anomaly_score") else "CAST(0.0 AS DOUBLE)", False
        ),
        "activity_levels": f"""WITH {_EVENTS},
r AS (SELECT strftime("timestamp", '%Y-%m-%d') AS day, event_type, c_mktsegment AS segment,
             CAST(transaction_amount AS DECIMAL(18, 6)) AS amount
      FROM ev LEFT JOIN customer ON user_id = printf('usr_%05d', c_custkey))
SELECT day, event_type, segment, grouping_id(day, event_type, segment) AS level, count(*) AS events,
       round(CAST(sum(amount) AS DOUBLE), 6) AS revenue, count(*) FILTER (event_type = 'purchase') AS purchases
FROM r GROUP BY GROUPING SETS ((day, event_type, segment), (day, event_type), (day, segment), (day), (event_type), (segment), ())""",
        "live_rows": f"WITH {_ONLINE} SELECT {_VECTOR_COLUMNS}, expires_at FROM online WHERE expires_at > {_NOW_EPOCH}",
        "freshness": f"{ages} SELECT * FROM ages",
        "freshness_report": f"""{ages}
SELECT count(*) AS users, round(quantile_cont(freshness_seconds, 0.5), 6) AS median_age,
       round(quantile_cont(freshness_seconds, 0.95), 6) AS p95_age,
       count(*) FILTER (freshness_seconds > 86400) AS violations,
       round(count(*) FILTER (freshness_seconds > 86400) / count(*) * 100, 1) AS violation_pct FROM ages""",
        "stalest_users": f"{ages} SELECT * FROM ages ORDER BY freshness_seconds DESC, user_id LIMIT 20",
        "sla_violations": f"""{ages}, {_SEEDS}
SELECT feature_name, CAST(freshness_sla_seconds AS INTEGER) AS freshness_sla_seconds, count(*) AS users,
       count(*) FILTER (freshness_seconds > freshness_sla_seconds) AS violations
FROM seeds CROSS JOIN ages GROUP BY ALL""",
        "stale_users": f"WITH {_ONLINE}, {ttl} SELECT user_id, ttl FROM ttls WHERE ttl > 0 AND ttl < 86400",
        "stale_users_sampled": f"""WITH {_ONLINE}, {ttl} SELECT user_id, ttl FROM ttls WHERE ttl > 0 AND ttl < 86400
AND user_id IN (SELECT user_id FROM online ORDER BY md5('7:' || user_id), user_id LIMIT 60)""",
        "extend_ttl": f"""WITH {_ONLINE}, {ttl}
SELECT user_id, computed_at, CASE WHEN ttl > 0 AND ttl < 86400 THEN {_NOW_EPOCH} + 172800.0 ELSE expires_at END AS expires_at
FROM online JOIN ttls USING (user_id)""",
        "latency_report": """WITH r AS (
  SELECT CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END IN (200, 404) AS ok, value AS ms FROM events)
SELECT count(*) AS requests, round(quantile_cont(ms, 0.5) FILTER (ok), 6) AS p50_ms,
       round(quantile_cont(ms, 0.95) FILTER (ok), 6) AS p95_ms, round(quantile_cont(ms, 0.99) FILTER (ok), 6) AS p99_ms,
       count(*) FILTER (NOT ok) AS errors, count(*) FILTER (ok AND ms > 50) AS above_sla,
       round(count(*) FILTER (ok AND ms > 50) / count(*) * 100, 1) AS above_sla_pct FROM r""",
        "throughput": throughput("1 hour"),
        "throughput_daily": throughput("1 day"),
        "metric_history": f"""WITH {metrics} SELECT * FROM metrics
WHERE metric_type IN ('psi_score', 'ks_statistic', 'consistency_rate') AND recorded_at > {_NOW} - INTERVAL '24 hours'
ORDER BY recorded_at DESC, feature_name, metric_type""",
        "recent_metrics": f"""WITH {metrics} SELECT * FROM metrics WHERE feature_name = 'view' AND metric_type = 'psi_score'
ORDER BY recorded_at DESC, metric_value LIMIT 100""",
    }


def _diagnosed(rows: str) -> str:
    """The rules as SQL over ``rows(feature_name, psi_score, ks_p_value, z_score)``."""
    return f"""
SELECT feature_name,
  CASE rule WHEN 1 THEN printf('Major distribution shift in %s (PSI=%.3f, Z=%.2f). Likely cause: Kafka consumer lag causing stale cached values or upstream data volume spike.', feature_name, psi_score, abs(z_score))
            WHEN 2 THEN printf('Moderate distribution shift in %s (PSI=%.3f). Possible upstream data quality issue or legitimate seasonal pattern.', feature_name, psi_score)
            WHEN 3 THEN printf('Statistically significant distribution change in %s (KS p-value=%.4f). Could be legitimate seasonal variation.', feature_name, ks_p_value)
            ELSE printf('Minor drift detected in %s. Insufficient signal for confident diagnosis.', feature_name) END AS probable_cause,
  CASE rule WHEN 1 THEN 'data_pipeline_delay' WHEN 2 THEN 'upstream_data_quality' WHEN 3 THEN 'seasonal_pattern' ELSE 'unknown' END AS cause_category,
  CAST(CASE rule WHEN 1 THEN 0.72 WHEN 2 THEN 0.55 WHEN 3 THEN 0.45 ELSE 0.3 END AS DOUBLE) AS confidence,
  feature_name AS affected_features,
  CASE rule WHEN 1 THEN '1. Check Kafka consumer lag for topic ecommerce.events.raw (group: feature-processor-cg)|2. Verify Redis TTL for features:' || feature_name[1:10] || ':* keys|3. Check Spark streaming micro-batch processing time in Spark UI|4. Review ingestion service logs for errors in the last hour'
            WHEN 2 THEN '1. Review event schema changes in ingestion service|2. Check null/invalid transaction_amount rates in raw events|3. Compare event volume to same time last week|4. Verify no recent schema migrations on upstream services'
            WHEN 3 THEN '1. Compare current distribution to same hour/day last week|2. Check for marketing campaigns or external events|3. Update baseline distribution if change is expected'
            ELSE '1. Continue monitoring|2. Collect more data before taking action' END AS remediation_steps,
  CASE rule WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS urgency,
  'Potential model accuracy degradation for features depending on ' || feature_name || '.' AS estimated_impact,
  'rule_based_fallback' AS model_used, CAST(0 AS INTEGER) AS tokens_used, true AS fallback_used
FROM (SELECT *, CASE WHEN psi_score > 0.2 AND abs(z_score) > 3 THEN 1 WHEN psi_score > 0.1 THEN 2
                     WHEN ks_p_value < 0.05 THEN 3 ELSE 4 END AS rule FROM {rows})"""  # noqa: E501


def _diagnosis_sql() -> dict[str, str]:
    reading = """CASE WHEN psi_score < 0.1 THEN 'no significant shift' WHEN psi_score < 0.2
       THEN 'moderate shift — monitor closely' ELSE 'major shift — investigate immediately' END"""
    users = """(SELECT user_id AS feature_name, round(avg(anomaly_score) / 4, 6) AS psi_score,
        round(avg(cart_abandon_ratio) / 4, 6) AS ks_p_value, round(-2 * max(anomaly_score), 6) AS z_score
 FROM vec GROUP BY user_id)"""
    return {
        "diagnose_features": f"{_with_drift(_REFERENCE)} {_diagnosed('drift')}",
        "diagnose_users": f"WITH {_EVENTS}, {_vector('vec', _DENSE)} {_diagnosed(users)}",
        "diagnosis_context": f"""{_with_drift(_DENSE)}, {_SEEDS}
SELECT feature_name, psi_score, {reading} AS psi_interpretation,
       CASE WHEN ks_p_value < 0.05 THEN 'true' ELSE 'false' END AS ks_significant,
       CASE WHEN abs(z_score) > 3 THEN 'true' ELSE 'false' END AS z_score_anomalous, severity,
       current_size AS sample_size, '2024-01-29T12:00:00Z' AS analysis_timestamp, owner
FROM drift LEFT JOIN seeds USING (feature_name)""",
        "most_severe_first": f"{_with_drift(_DENSE)} SELECT feature_name, psi_score, severity FROM drift WHERE is_drifting",
        "describe_features": f"""{_with_drift(_DENSE)}, {_SEEDS}
SELECT feature_name, severity, window_type, CAST(freshness_sla_seconds AS INTEGER) AS freshness_sla_seconds, owner
FROM drift LEFT JOIN seeds USING (feature_name)""",
        "feature_lineage": f"""WITH {_samples(_DENSE)}, {_SEEDS}
SELECT feature_name, count(*) FILTER (value > 0) AS n_positive, CAST(step AS INTEGER) AS step,
       CASE step WHEN 1 THEN 'kafka:ecommerce.events.raw' ELSE 'pyspark:structured_streaming' END AS upstream_source,
       CASE step WHEN 1 THEN step_1 ELSE step_2 END AS transform_step
FROM samples JOIN seeds USING (feature_name) CROSS JOIN (VALUES (1), (2)) t(step) GROUP BY ALL""",
        "get_feature": f"""WITH {_samples(_DENSE)}, {_SEEDS}
SELECT feature_name, count(*) AS n_values, owner, CAST(2 AS INTEGER) AS n_steps
FROM samples JOIN seeds USING (feature_name) WHERE feature_name = 'anomaly_score' GROUP BY ALL""",
        "missing_seeds": f"""WITH {_samples(_DENSE)}, {_SEEDS}
SELECT feature_name, owner FROM seeds WHERE feature_name NOT IN (SELECT feature_name FROM samples WHERE value > 3)""",
    }


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for group in (
        _feature_sql, _source_sql, _store_sql, _user_sql, _drift_sql, _consistency_sql, _serving_sql, _diagnosis_sql,
    ):
        found.update(group())
    # Another way to the same rows.
    for name, same in (
        ("refresh_by_function", "refresh_features"),
        ("bucketed_deviation", "relative_deviation"),
        ("bucketed_lookup", "serve_features"),
    ):
        found[name] = found[same]
    return found
