"""Independent SQL for the registered queries.

The canonical tables are restated as SQL, and every operator is written in another way than
the library does it: coverage by counting single days, knowledge by pairing each candidate
with all claims, ranks by plain windows, and so on.
"""

from __future__ import annotations

TABLES = """
patients AS (
  SELECT CAST(c_custkey AS VARCHAR) AS patient_id,
         CAST(1930 + c_custkey % 60 AS INTEGER) AS birth_year,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         n_name AS geography, DATE '1995-01-01' AS observation_start,
         CASE WHEN c_custkey % 11 = 0 THEN DATE '1999-06-30' ELSE DATE '2001-12-31' END
           AS observation_end
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
med AS (
  SELECT 'm' || o_orderkey AS claim_id, CAST(o_custkey AS VARCHAR) AS patient_id,
         CAST(o_orderdate AS DATE) AS claim_date,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS available_date,
         CASE WHEN o_orderkey % 17 = 0 THEN 'rejected' ELSE 'final' END AS status,
         o_orderpriority AS diagnosis_code,
         CASE WHEN o_orderkey % 3 = 0 THEN 'PX' || (o_orderkey % 10) END AS procedure_code,
         CAST(o_orderkey % 10 AS VARCHAR) AS provider_id,
         CASE o_orderstatus WHEN 'F' THEN 'office' WHEN 'O' THEN 'emergency'
              ELSE 'urgent_care' END AS place_of_service
  FROM orders),
rx AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' ||
           CAST(l_quantity AS INTEGER) || '-' || CAST(l_shipdate AS DATE) AS claim_id,
         CAST(o_custkey AS VARCHAR) AS patient_id,
         CAST(l_shipdate AS DATE) AS fill_date,
         CAST(l_shipdate AS DATE) + l_linenumber AS available_date,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'rejected'
              WHEN l_returnflag = 'A' THEN 'final' ELSE 'paid' END AS status,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O'
              THEN CAST(l_shipdate AS DATE) + l_linenumber + 30 END AS reversal_date,
         CAST(l_partkey AS VARCHAR) AS drug_id,
         CASE WHEN p_brand = 'Brand#17' THEN 'advanced' WHEN p_type = 'ECONOMY' THEN 'other'
              ELSE 'conventional' END AS therapy_class,
         l_quantity AS quantity, CAST(l_quantity AS INTEGER) AS days_supply,
         CAST(l_suppkey AS VARCHAR) AS prescriber_id, c_mktsegment AS plan_id,
         floor(l_extendedprice * l_discount * 100) / CAST(100 AS DOUBLE) AS patient_cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN customer ON o_custkey = c_custkey),
providers AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS provider_id, r_name AS specialty,
         n_name AS geography, s_name AS organization
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey),
plans AS (
  SELECT DISTINCT c_mktsegment AS plan_id,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'commercial'
              WHEN c_mktsegment = 'AUTOMOBILE' THEN 'medicare' ELSE 'medicaid' END AS payer_type
  FROM customer),
enrollment AS (
  SELECT CAST(c_custkey AS VARCHAR) AS patient_id, DATE '1995-01-01' AS coverage_start,
         CASE WHEN c_custkey % 7 = 0 THEN DATE '1998-03-31' ELSE DATE '2001-12-31' END
           AS coverage_end, c_mktsegment AS plan_id
  FROM customer
  UNION ALL
  SELECT CAST(c_custkey AS VARCHAR),
         CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-04-01' ELSE DATE '1998-05-01' END,
         DATE '2001-12-31', c_mktsegment
  FROM customer WHERE c_custkey % 7 = 0),
mapping AS (
  SELECT CAST(p_partkey AS VARCHAR) AS drug_id,
         CASE WHEN p_brand = 'Brand#17' THEN 'advanced' WHEN p_type = 'ECONOMY' THEN 'other'
              ELSE 'conventional' END AS therapy_class,
         DATE '1990-01-01' AS effective_start,
         CASE WHEN p_partkey % 5 = 0 THEN DATE '1998-06-30' ELSE DATE '2030-01-01' END
           AS effective_end
  FROM part
  UNION ALL
  SELECT CAST(p_partkey AS VARCHAR),
         CASE WHEN p_brand = 'Brand#17' THEN 'advanced' WHEN p_type = 'ECONOMY' THEN 'other'
              ELSE 'conventional' END, DATE '1998-07-01', DATE '2030-01-01'
  FROM part WHERE p_partkey % 5 = 0)
"""

DX = "('1-URGENT', '2-HIGH', '3-MEDIUM')"
VALID = "('paid', 'final')"


def with_tables(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([TABLES, *ctes]) + "\n" + body


# Candidates, then every candidate paired with every claim it knows.
CANDIDATES = """
cand AS (
  SELECT patient_id, CAST(d AS DATE) AS t
  FROM patients, generate_series(DATE '1997-01-01', DATE '2000-12-01', INTERVAL 1 MONTH) g(d))
"""
LIVE_CANDIDATES = "cand AS (SELECT patient_id, DATE '2001-06-01' AS t FROM patients)"


def assessment(labelled: bool) -> list[str]:
    adv_lag = 7 if labelled else 0
    follow = 180 if labelled else 0
    as_of = "DATE '2001-12-31'" if labelled else "DATE '2001-06-01'"
    immature = f"t + 210 > {as_of}" if labelled else "FALSE"
    return [
        CANDIDATES if labelled else LIVE_CANDIDATES,
        f"""
rx_known AS (
  SELECT c.t, r.* FROM cand c JOIN rx r USING (patient_id)
  WHERE r.fill_date <= c.t - 7 AND r.available_date <= c.t
    AND CASE WHEN r.reversal_date <= c.t THEN 'reversed' ELSE r.status END IN {VALID})""",
        """
conv AS (SELECT * FROM rx_known WHERE therapy_class = 'conventional')""",
        """
days AS (
  SELECT DISTINCT patient_id, t, fill_date + CAST(i AS INTEGER) AS day
  FROM (SELECT patient_id, t, fill_date, unnest(range(0, days_supply)) AS i FROM conv
        WHERE fill_date + days_supply > t - 179)
  WHERE fill_date + CAST(i AS INTEGER) BETWEEN t - 179 AND t)""",
        """
steps AS (
  SELECT patient_id, t, day,
         day - lag(day, 1, t - 180) OVER (PARTITION BY patient_id, t ORDER BY day) - 1 AS gap
  FROM days)""",
        """
cover AS (
  SELECT patient_id, t, count(*) AS covered,
         greatest(max(gap), max(t) - max(day)) AS widest FROM steps GROUP BY ALL)""",
        f"""
dx AS (
  SELECT c.patient_id, c.t, m.claim_date FROM cand c JOIN med m USING (patient_id)
  WHERE m.claim_date <= c.t - 7 AND m.available_date <= c.t AND m.status IN {VALID}
    AND m.diagnosis_code IN {DX})""",
        """
dx_first AS (SELECT patient_id, t, min(claim_date) AS first_dx FROM dx GROUP BY ALL)""",
        """
dx_ok AS (
  SELECT DISTINCT patient_id, t FROM dx JOIN dx_first USING (patient_id, t)
  WHERE claim_date > first_dx + 90)""",
        """
fills AS (SELECT patient_id, t, min(fill_date) AS first_fill FROM conv GROUP BY ALL)""",
        f"""
prior AS (
  SELECT DISTINCT c.patient_id, c.t FROM cand c JOIN rx r USING (patient_id)
  WHERE r.therapy_class = 'advanced' AND r.fill_date <= c.t - {adv_lag}
    AND r.available_date <= c.t
    AND CASE WHEN r.reversal_date <= c.t THEN 'reversed' ELSE r.status END IN {VALID})""",
        f"""
result AS (
  SELECT c.patient_id, c.t, min(r.fill_date) AS outcome FROM cand c JOIN rx r USING (patient_id)
  WHERE r.therapy_class = 'advanced' AND r.fill_date > c.t AND r.fill_date <= c.t + 180
    AND r.available_date <= c.t + 210
    AND CASE WHEN r.reversal_date <= c.t + 210 THEN 'reversed' ELSE r.status END IN {VALID}
  GROUP BY ALL)""",
        f"""
enrolled AS (
  SELECT c.patient_id, c.t,
         sum(greatest(0, least(e.coverage_end, c.t + {follow})
                         - greatest(e.coverage_start, c.t - 365) + 1)) AS n
  FROM cand c JOIN enrollment e USING (patient_id) GROUP BY ALL)""",
        f"""
facts AS MATERIALIZED (
  SELECT c.patient_id || '__' || strftime(c.t, '%Y%m%d') AS snapshot_id, c.patient_id, c.t,
         f.first_fill, o.outcome, coalesce(v.covered, 0) AS covered,
         coalesce(v.widest, 180) AS widest,
         CASE WHEN c.t > {as_of} THEN 'future_index'
              WHEN {immature} THEN 'immature_label'
              WHEN p.observation_start > c.t - 365 OR p.observation_end < c.t + {follow}
                   OR coalesce(e.n, 0) < 366 + {follow}
                THEN 'insufficient_observation_or_enrollment'
              WHEN d.t IS NULL THEN 'diagnosis_not_confirmed'
              WHEN f.t IS NULL THEN 'no_conventional_exposure'
              WHEN coalesce(v.covered, 0) < 40 THEN 'insufficient_conventional_coverage'
              WHEN v.widest > 120 THEN 'conventional_gap'
              WHEN a.t IS NOT NULL THEN 'known_prior_advanced' END AS reason
  FROM cand c JOIN patients p USING (patient_id)
  LEFT JOIN fills f USING (patient_id, t) LEFT JOIN cover v USING (patient_id, t)
  LEFT JOIN dx_ok d USING (patient_id, t) LEFT JOIN prior a USING (patient_id, t)
  LEFT JOIN result o USING (patient_id, t) LEFT JOIN enrolled e USING (patient_id, t))""",
        f"""
snap AS (
  SELECT snapshot_id, patient_id, t AS index_date, t - 7 AS feature_cutoff,
         t - 365 AS lookback_start, first_fill AS start_dt, t + 180 AS prediction_end,
         t + 210 AS label_available_date, CAST(outcome IS NOT NULL AS INTEGER) AS label,
         outcome AS outcome_date, CAST(covered AS INTEGER) AS covered_days,
         CAST(widest AS INTEGER) AS maximum_gap_days,
         ((covered * 7 + widest * 3) % 101) / CAST(100.0 AS DOUBLE) AS score
  FROM facts WHERE reason IS NULL)""",
    ]


COHORT = assessment(True)
LIVE = assessment(False)

EVENTS = f"""
seen_med AS (
  SELECT s.snapshot_id, s.index_date, m.*, coalesce(p.specialty, 'unknown') AS specialty
  FROM snap s JOIN med m USING (patient_id) LEFT JOIN providers p USING (provider_id)
  WHERE m.claim_date BETWEEN s.lookback_start AND s.feature_cutoff
    AND m.available_date <= s.index_date),
seen_rx AS (
  SELECT s.snapshot_id, s.index_date, r.* REPLACE (
           CASE WHEN r.reversal_date <= s.index_date THEN 'reversed' ELSE r.status END AS status),
         coalesce(p.specialty, 'unknown') AS specialty
  FROM snap s JOIN rx r USING (patient_id)
  LEFT JOIN providers p ON p.provider_id = r.prescriber_id
  WHERE r.fill_date BETWEEN s.lookback_start AND s.feature_cutoff
    AND r.available_date <= s.index_date),
ev AS (
  SELECT snapshot_id, patient_id, index_date, claim_id || '__diagnosis' AS event_id,
         claim_date AS event_date, available_date, 'diagnosis_' || status AS event_type,
         'diagnosis' AS code_system, diagnosis_code AS code, provider_id AS hcp_id,
         '' AS product_id, 'none' AS therapy_class, specialty AS provider_specialty, status,
         place_of_service
  FROM seen_med WHERE diagnosis_code IS NOT NULL
  UNION ALL
  SELECT snapshot_id, patient_id, index_date, claim_id || '__procedure', claim_date,
         available_date, 'procedure_' || status, 'procedure', procedure_code, provider_id, '',
         'none', specialty, status, place_of_service
  FROM seen_med WHERE procedure_code IS NOT NULL
  UNION ALL
  SELECT snapshot_id, patient_id, index_date, claim_id || '__pharmacy', fill_date,
         available_date, 'pharmacy_' || status, 'pharmacy', drug_id, prescriber_id, drug_id,
         therapy_class, specialty, status, 'pharmacy'
  FROM seen_rx),
event AS (
  SELECT *, code_system || '::' || code AS code_token,
         CAST(index_date - event_date AS INTEGER) AS days_before_index
  FROM ev)"""


def on_cohort(body: str, *ctes: str) -> str:
    return with_tables(body, *COHORT, *ctes)


def on_live(body: str, *ctes: str) -> str:
    return with_tables(body, *LIVE, *ctes)


def on_events(body: str, *ctes: str) -> str:
    return on_cohort(body, EVENTS, *ctes)


# --- wide features ----------------------------------------------------------------------

WINDOWS = (30, 60, 90, 180, 365)


def counts_sql() -> str:
    dx = "event_type IN ('diagnosis_final', 'diagnosis_paid')"
    special = f"{dx} AND provider_specialty IN ('EUROPE', 'ASIA')"
    columns = []
    for w in WINDOWS:
        near = f"days_before_index <= {w}"
        for kind in ("diagnosis", "procedure", "pharmacy"):
            columns.append(
                f"count(*) FILTER (code_system = '{kind}' AND {near}) AS {kind}_count_{w}d"
            )
        columns += [
            f"count(*) FILTER ({special} AND {near}) AS specialist_visits_{w}d",
            f"count(*) FILTER ({dx} AND place_of_service = 'emergency' AND {near}) "
            f"AS emergency_visits_{w}d",
            f"count(*) FILTER ({dx} AND place_of_service = 'urgent_care' AND {near}) "
            f"AS urgent_visits_{w}d",
            f"count(*) FILTER (event_type = 'pharmacy_rejected' AND {near}) AS rejected_rx_{w}d",
            f"count(*) FILTER (event_type = 'pharmacy_reversed' AND {near}) AS reversed_rx_{w}d",
            f"round(coalesce(sum(patient_cost) FILTER ({near}), 0.0), 2) AS patient_cost_{w}d",
        ]
    for name, cond in (("diagnosis", dx), ("specialist", special)):
        now = f"count(*) FILTER ({cond} AND days_before_index <= 90)"
        before = f"count(*) FILTER ({cond} AND days_before_index BETWEEN 91 AND 180)"
        columns += [
            f"coalesce(min(days_before_index) FILTER ({cond}), 366) AS days_since_last_{name}",
            f"{now} - {before} AS {name}_acceleration",
            f"round(({now} + 1) / CAST({before} + 1 AS DOUBLE), 2) AS {name}_recent_prior_ratio",
        ]
    columns += [
        f"count(*) FILTER ({dx} AND code IN ('1-URGENT', '2-HIGH')) AS symptom_count",
        f"count(*) FILTER ({dx} AND code = '5-LOW') AS comorbidity_count",
    ]
    return f"""
counts AS (
  SELECT snapshot_id, {', '.join(columns)}
  FROM event e LEFT JOIN (SELECT claim_id || '__pharmacy' AS event_id, patient_cost FROM rx) c
       USING (event_id)
  GROUP BY snapshot_id)"""


COVER_DAYS = f"""
conv_all AS (
  SELECT s.snapshot_id, s.index_date, s.lookback_start, r.*
  FROM snap s JOIN rx r USING (patient_id)
  WHERE r.fill_date <= s.index_date - 7 AND r.available_date <= s.index_date
    AND r.therapy_class = 'conventional'
    AND CASE WHEN r.reversal_date <= s.index_date THEN 'reversed' ELSE r.status END IN {VALID}),
single AS (
  SELECT DISTINCT snapshot_id, index_date, fill_date + CAST(i AS INTEGER) AS day
  FROM (SELECT *, unnest(range(0, days_supply)) AS i FROM conv_all)
  WHERE fill_date + CAST(i AS INTEGER) BETWEEN lookback_start AND index_date),
hops AS (
  SELECT *, day - lag(day, 1, index_date - 366) OVER (PARTITION BY snapshot_id ORDER BY day) - 1
            AS gap FROM single),
covered AS (
  SELECT snapshot_id, count(*) / CAST(366 AS DOUBLE) AS proportion_days_covered,
         CAST(greatest(max(gap), max(index_date) - max(day)) AS INTEGER)
           AS maximum_therapy_gap_days,
         count(*) FILTER (day >= index_date - 89) / CAST(90 AS DOUBLE) AS recent_coverage_90d,
         count(*) FILTER (day BETWEEN index_date - 179 AND index_date - 90)
           / CAST(90 AS DOUBLE) AS previous_coverage_90d
  FROM hops GROUP BY snapshot_id)"""

THERAPY = """
ordered AS (
  SELECT *, lag(drug_id) OVER (PARTITION BY snapshot_id ORDER BY fill_date, claim_id) AS before
  FROM conv_all WHERE fill_date >= lookback_start),
recent AS (
  SELECT snapshot_id, count(*) FILTER (before IS NOT NULL AND before <> drug_id) AS changes,
         count(DISTINCT drug_id) AS tried, max(fill_date) AS last_fill,
         max(fill_date) FILTER (before IS NOT NULL AND before <> drug_id) AS last_change
  FROM ordered GROUP BY snapshot_id),
latest AS (
  SELECT snapshot_id, drug_id, prescriber_id
  FROM conv_all
  QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY fill_date DESC, claim_id DESC) = 1),
therapy AS (
  SELECT s.snapshot_id, coalesce(l.drug_id, 'unknown') AS current_therapy,
         CAST(coalesce(r.changes, 0) AS INTEGER) AS therapy_changes,
         CAST(coalesce(r.tried, 0) AS INTEGER) AS therapies_tried,
         CAST(coalesce(s.index_date - s.start_dt, 0) AS INTEGER) AS therapy_duration_days,
         CAST(coalesce(s.index_date - r.last_fill, 366) AS INTEGER) AS days_since_last_rx,
         CAST(coalesce(s.index_date - r.last_change, 366) AS INTEGER)
           AS days_since_last_treatment_change
  FROM snap s LEFT JOIN latest l USING (snapshot_id) LEFT JOIN recent r USING (snapshot_id))"""

PEERS = f"""
pairs AS (
  SELECT DISTINCT s.snapshot_id, r.patient_id AS peer,
         r.therapy_class = 'advanced' AS adv
  FROM snap s JOIN latest l USING (snapshot_id)
  JOIN rx r ON r.prescriber_id = l.prescriber_id AND r.patient_id <> s.patient_id
  WHERE r.fill_date BETWEEN s.lookback_start AND s.index_date - 7
    AND r.available_date <= s.index_date
    AND CASE WHEN r.reversal_date <= s.index_date THEN 'reversed' ELSE r.status END IN {VALID}),
peers AS (
  SELECT s.snapshot_id,
         count(DISTINCT peer) FILTER (adv) AS hcp_historical_advanced_patients,
         count(DISTINCT peer) AS hcp_historical_patients
  FROM snap s LEFT JOIN pairs USING (snapshot_id) GROUP BY s.snapshot_id)"""

PAYER = """
payer AS (
  SELECT s.snapshot_id, p.payer_type FROM snap s JOIN enrollment e USING (patient_id)
  JOIN plans p USING (plan_id) WHERE s.index_date BETWEEN e.coverage_start AND e.coverage_end)"""

COVERAGE_COLUMNS = """round(proportion_days_covered, {p}) AS proportion_days_covered,
  maximum_therapy_gap_days, round(recent_coverage_90d, {p}) AS recent_coverage_90d,
  round(previous_coverage_90d, {p}) AS previous_coverage_90d,
  round(recent_coverage_90d - previous_coverage_90d, {p}) AS coverage_change"""


def wide_sql() -> str:
    # Counts are rounded to two places inside their own query; the wide table keeps four.
    zero = []
    for w in WINDOWS:
        for c in ("diagnosis_count", "procedure_count", "pharmacy_count", "specialist_visits",
                  "emergency_visits", "urgent_visits", "rejected_rx", "reversed_rx",
                  "patient_cost"):
            zero.append(f"coalesce({c}_{w}d, 0) AS {c}_{w}d")
    for n in ("diagnosis", "specialist"):
        zero += [
            f"coalesce(days_since_last_{n}, 366) AS days_since_last_{n}",
            f"coalesce({n}_acceleration, 0) AS {n}_acceleration",
            f"coalesce({n}_recent_prior_ratio, 1.0) AS {n}_recent_prior_ratio",
        ]
    body = f"""
SELECT s.snapshot_id, s.index_date AS feature_as_of,
  CAST(year(s.index_date) - birth_year AS INTEGER) AS age, gender, geography,
  coalesce(payer_type, 'unknown') AS payer_type,
  t.* EXCLUDE (snapshot_id), {', '.join(zero)},
  {COVERAGE_COLUMNS.format(p=4)},
  coalesce(symptom_count, 0) AS symptom_count,
  coalesce(comorbidity_count, 0) AS comorbidity_count,
  hcp_historical_advanced_patients, hcp_historical_patients
FROM snap s JOIN patients USING (patient_id) JOIN therapy t USING (snapshot_id)
JOIN covered USING (snapshot_id) JOIN peers USING (snapshot_id)
LEFT JOIN counts USING (snapshot_id) LEFT JOIN payer USING (snapshot_id)"""
    counts = counts_sql().replace(", 2) AS diagnosis_recent", ", 4) AS diagnosis_recent").replace(
        ", 2) AS specialist_recent", ", 4) AS specialist_recent"
    )
    return on_events(body, counts, COVER_DAYS, THERAPY, PEERS, PAYER)


# --- history ----------------------------------------------------------------------------

TOKENS = """
tok AS (SELECT *, event_type || '::' || code_token AS history_token FROM event),
vocab AS (
  SELECT history_token, count(*) AS events, row_number() OVER (
           ORDER BY count(*) DESC, history_token) - 1 AS i
  FROM tok GROUP BY history_token)"""


def history_sql(codes: int = 24, windows=(14, 30, 90, 365)) -> str:
    columns = []
    for i in range(codes):
        for w in windows:
            columns.append(
                f"round(ln(1 + count(*) FILTER (v.i = {i} AND days_before_index <= {w})), 6) "
                f"AS history_code_{i}_count_{w}d"
            )
        columns.append(
            f"CAST(coalesce(min(days_before_index) FILTER (v.i = {i}), 366) AS DOUBLE) "
            f"AS history_code_{i}_recency"
        )
    for w in windows:
        columns += [
            f"round(ln(1 + count(DISTINCT event_date) FILTER (days_before_index <= {w})), 6) "
            f"AS history_visit_dates_{w}d",
            f"CAST(count(DISTINCT t.history_token) FILTER (days_before_index <= {w}) AS DOUBLE) "
            f"AS history_code_diversity_{w}d",
        ]
    body = f"""
SELECT s.snapshot_id, {', '.join(columns)},
  round(coalesce(any_value(g.mean), 366), 6) AS history_visit_gap_mean,
  round(coalesce(any_value(g.std), 0), 6) AS history_visit_gap_std,
  CAST(coalesce(any_value(g.final), 366) AS DOUBLE) AS history_visit_gap_last
FROM snap s LEFT JOIN tok t USING (snapshot_id) LEFT JOIN vocab v USING (history_token)
LEFT JOIN (
  SELECT snapshot_id, avg(gap) AS mean, stddev_samp(gap) AS std,
         max_by(gap, event_date) AS final
  FROM (SELECT snapshot_id, event_date, event_date - lag(event_date) OVER (
          PARTITION BY snapshot_id ORDER BY event_date) AS gap
        FROM (SELECT DISTINCT snapshot_id, event_date FROM event))
  GROUP BY snapshot_id) g USING (snapshot_id)
GROUP BY s.snapshot_id"""
    return on_events(body, TOKENS)


# --- sequences --------------------------------------------------------------------------

VOCABULARY = """
words AS (
  SELECT 'event_type' AS vocab_key, event_type AS token FROM event
  UNION ALL SELECT 'code', code_token FROM event
  UNION ALL SELECT 'therapy_class', therapy_class FROM event
  UNION ALL SELECT 'specialty', provider_specialty FROM event),
frequent AS (SELECT vocab_key, token FROM words GROUP BY ALL HAVING count(*) >= 2),
voc AS (
  SELECT vocab_key, token, CAST(1 + (
    SELECT count(*) FROM frequent g WHERE g.vocab_key = f.vocab_key AND g.token <= f.token)
    AS INTEGER) AS id
  FROM frequent f
  UNION ALL
  SELECT vocab_key, '<PAD>', 0 FROM (SELECT DISTINCT vocab_key FROM words)
  UNION ALL
  SELECT vocab_key, '<UNK>', 1 FROM (SELECT DISTINCT vocab_key FROM words))"""

TAIL = """
numbered AS (
  SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY snapshot_id) AS n
  FROM event WINDOW w AS (PARTITION BY snapshot_id ORDER BY event_date, event_id)),
tail AS (
  SELECT * EXCLUDE (r, n), CAST(r - 1 - greatest(0, n - 12) AS INTEGER) AS position,
         CAST(CASE WHEN r - 1 - greatest(0, n - 12) = 0 THEN 0 ELSE event_date - lag(event_date)
              OVER (PARTITION BY snapshot_id ORDER BY event_date, event_id) END AS INTEGER)
           AS delta
  FROM numbered WHERE r > n - 12)"""

CODED = """
coded AS (
  SELECT t.*, coalesce(a.id, 1) AS a, coalesce(b.id, 1) AS b, coalesce(c.id, 1) AS c,
         coalesce(d.id, 1) AS d
  FROM tail t
  LEFT JOIN voc a ON a.vocab_key = 'event_type' AND a.token = t.event_type
  LEFT JOIN voc b ON b.vocab_key = 'code' AND b.token = t.code_token
  LEFT JOIN voc c ON c.vocab_key = 'therapy_class' AND c.token = t.therapy_class
  LEFT JOIN voc d ON d.vocab_key = 'specialty' AND d.token = t.provider_specialty)"""


def encoded_sql() -> str:
    def padded(column: str, name: str, fill: str = "'0'") -> str:
        return (
            f"array_to_string(list_concat(coalesce(list(CAST({column} AS VARCHAR) "
            f"ORDER BY position) FILTER (position IS NOT NULL), []), "
            f"list_transform(range(0, 12 - count(position)), lambda x: {fill})), ',') AS {name}"
        )

    body = f"""
SELECT s.snapshot_id, any_value(s.label) AS label,
  {padded('a', 'event_type_ids')}, {padded('b', 'code_ids')},
  {padded('c', 'therapy_class_ids')}, {padded('d', 'specialty_ids')},
  {padded("CASE WHEN position IS NOT NULL THEN 'true' END", 'attention_mask', "'false'")},
  {padded('delta', 'time_delta_days')}, {padded('days_before_index', 'days_before_index')},
  coalesce(array_to_string(list(CAST(event_date AS VARCHAR) ORDER BY position)
    FILTER (position IS NOT NULL), ','), '') AS event_dates,
  CAST(count(position) AS INTEGER) AS length
FROM snap s LEFT JOIN coded USING (snapshot_id) GROUP BY s.snapshot_id"""
    return on_events(body, VOCABULARY, TAIL, CODED)


# --- splits and ranking -----------------------------------------------------------------

SPLIT = """
firsts AS (SELECT patient_id, min(index_date) AS first_index FROM snap GROUP BY patient_id),
split AS (
  SELECT s.*, CASE
    WHEN first_index <= DATE '1998-01-01' AND label_available_date <= DATE '1998-01-01'
      THEN 'train'
    WHEN first_index > DATE '1998-01-01' AND first_index <= DATE '1999-06-01'
         AND index_date > DATE '1998-01-01' AND label_available_date <= DATE '1999-06-01'
      THEN 'validation'
    WHEN first_index > DATE '1999-06-01' AND index_date > DATE '1999-06-01' THEN 'test' END
    AS split
  FROM snap s JOIN firsts USING (patient_id))"""

LATEST = """
last AS (
  SELECT * FROM snap QUALIFY row_number() OVER (
    PARTITION BY patient_id ORDER BY index_date DESC, snapshot_id DESC) = 1)"""

RANKED = """
ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, patient_id) AS rank,
         count(*) OVER () AS n FROM last)"""

AP = """
(SELECT sum(CAST(pos AS DOUBLE) / total * tp / k) FROM (
   SELECT DISTINCT score, sum(label) OVER (PARTITION BY score) AS pos,
          sum(label) OVER (ORDER BY score DESC) AS tp,
          count(*) OVER (ORDER BY score DESC) AS k, sum(label) OVER () AS total
   FROM last))"""

AUC = """
(SELECT avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END)
 FROM (SELECT score FROM last WHERE label = 1) p, (SELECT score FROM last WHERE label = 0) q)"""


def threshold_values(where: str = "TRUE") -> str:
    """Confusion metrics at each row of ``cuts(threshold)``."""
    return f"""
conf AS (
  SELECT threshold, CAST(sum(CASE WHEN score >= threshold THEN label ELSE 0 END) AS DOUBLE) AS tp,
         CAST(sum(CASE WHEN score >= threshold THEN 1 - label ELSE 0 END) AS DOUBLE) AS fp,
         CAST(sum(CASE WHEN score < threshold THEN label ELSE 0 END) AS DOUBLE) AS fn,
         CAST(sum(CASE WHEN score < threshold THEN 1 - label ELSE 0 END) AS DOUBLE) AS tn,
         count(*) AS rows
  FROM cuts, last WHERE {where} GROUP BY threshold),
curve AS (
  SELECT threshold, rows,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
         CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END AS specificity,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
         CASE WHEN tp + fn = 0 THEN tn / (tn + fp) WHEN tn + fp = 0 THEN tp / (tp + fn)
              ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS balanced_accuracy
  FROM conf)"""


CURVE_COLUMNS = ", ".join(
    f"round({c}, 6) AS {c}" for c in ("precision", "recall", "specificity", "f1",
                                      "balanced_accuracy")
)


def top_metrics(fractions: tuple[float, ...]) -> str:
    parts = []
    for f in fractions:
        k = f"least(n, greatest(1, CAST(ceil(n * CAST({f} AS DOUBLE)) AS BIGINT)))"
        parts.append(f"""
SELECT '{f * 100:g}%' AS at, CAST({f} AS DOUBLE) AS fraction, any_value({k}) AS selected_count,
  CAST(sum(label) FILTER (rank <= {k}) AS BIGINT) AS selected_positives,
  CAST(sum(label) AS BIGINT) AS total_positives,
  round(sum(label) FILTER (rank <= {k}) / nullif(CAST(sum(label) AS DOUBLE), 0), 6) AS recall,
  round(sum(label) FILTER (rank <= {k}) / CAST(any_value({k}) AS DOUBLE), 6) AS precision,
  round(sum(label) FILTER (rank <= {k}) / CAST(any_value({k}) AS DOUBLE)
        / nullif(avg(label), 0), 6) AS lift
FROM ranked""")
    return " UNION ALL ".join(parts)


CLASS_COLUMNS = f"""
  round({AUC}, 6) AS roc_auc, round({AP}, 6) AS pr_auc, {CURVE_COLUMNS},
  (SELECT round(avg(CASE WHEN label = 1
      THEN -ln(greatest(least(score, 1 - 2.220446049250313e-16), 2.220446049250313e-16))
      ELSE -ln(1 - greatest(least(score, 1 - 2.220446049250313e-16), 2.220446049250313e-16))
      END), 6) FROM last) AS log_loss,
  (SELECT round(avg((score - label) ** 2), 6) FROM last) AS brier_score,
  threshold"""


def tuning_sql() -> str:
    parts = []
    for name in ("f1", "recall", "precision", "balanced_accuracy", "target_recall"):
        value = "CASE WHEN recall >= 0.5 THEN precision END" if name == "target_recall" else name
        shown = "precision_at_recall_0.5" if name == "target_recall" else name
        parts.append(f"""
(SELECT round(threshold, 6) AS threshold, '{shown}' AS objective,
   round({value}, 6) AS objective_value, rows AS validation_sample_size,
   (SELECT count(*) FROM cuts) AS candidate_count
 FROM curve ORDER BY round({value}, 9) DESC NULLS LAST, curve.threshold DESC LIMIT 1)""")
    cuts = "cuts AS (SELECT DISTINCT score AS threshold FROM last UNION SELECT 0.0 UNION SELECT 1.0)"
    return on_cohort(" UNION ALL ".join(parts), LATEST, cuts, threshold_values())


# --- providers --------------------------------------------------------------------------

PROVIDER_EVENTS = f"""
pe AS (
  SELECT patient_id, provider_id, claim_date, 'visit' AS role, status IN {VALID} AS ok FROM med
  UNION ALL
  SELECT patient_id, prescriber_id, fill_date, 'prescriber', status IN {VALID} FROM rx),
tagged AS (SELECT * FROM pe LEFT JOIN providers USING (provider_id) WHERE ok)"""


def attribution_sql(rule: str, where: str, name: str = "chosen") -> str:
    order = "last DESC, n DESC" if rule.startswith("most_recent") else "n DESC, last DESC"
    return f"""
{name} AS (
  SELECT patient_id, provider_id AS hcp_id, '{rule}' AS attribution_method,
         n AS attribution_claim_count, last AS attribution_last_date
  FROM (SELECT patient_id, provider_id, count(*) AS n, max(claim_date) AS last
        FROM tagged WHERE {where} GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY {order}, provider_id) = 1)"""


PLURAL = attribution_sql("plurality_of_relevant_claims", "TRUE")

FLAGS = """
flagged AS (
  SELECT patient_id, score,
         score >= (SELECT quantile_cont(score, 0.9) FROM last) AS high,
         rank <= greatest(1, ceil(n * CAST(0.05 AS DOUBLE))) AS top5,
         rank <= greatest(1, ceil(n * CAST(0.1 AS DOUBLE))) AS top10,
         rank <= greatest(1, ceil(n * CAST(0.2 AS DOUBLE))) AS top20
  FROM ranked),
opp AS (
  SELECT hcp_id, count(*) AS eligible_patient_count,
         count(*) FILTER (high) AS high_propensity_patient_count,
         count(*) FILTER (top5) AS patients_top_5pct,
         count(*) FILTER (top10) AS patients_top_10pct,
         count(*) FILTER (top20) AS patients_top_20pct,
         round(avg(score), 10) AS mean_patient_propensity,
         round(max(score), 10) AS max_patient_propensity,
         round(sum(score), 10) AS expected_switchers
  FROM flagged JOIN chosen USING (patient_id) GROUP BY hcp_id)"""


def score_sql(how: str) -> str:
    weights = {"expected_switchers": 0.5, "patients_top_10pct": 0.25,
               "eligible_patient_count": 0.25}
    names, total = [], []
    for metric, w in weights.items():
        if how == "minmax":
            value = (
                f"CASE WHEN max({metric}) OVER () - min({metric}) OVER () <= "
                f"1e-8 + 1e-5 * abs(max({metric}) OVER ()) THEN 0.0 ELSE "
                f"({metric} - min({metric}) OVER ()) / CAST(max({metric}) OVER () - "
                f"min({metric}) OVER () AS DOUBLE) END"
            )
        else:
            value = (
                f"(rank() OVER (ORDER BY {metric}) + (count(*) OVER (PARTITION BY {metric}) - 1)"
                f" / CAST(2 AS DOUBLE)) / count(*) OVER ()"
            )
        names.append(f"CAST({w} AS DOUBLE) * ({value}) AS score_component__{metric}")
        total.append(f"score_component__{metric}")
    formula = " + ".join(f"{w:.6g}*{how}({m})" for m, w in weights.items())
    rounds = ", ".join(f"round({c}, 10) AS {c}" for c in total)
    return on_cohort(
        f"""
SELECT opp.* , {rounds.replace('round(', 'round(p.')}, round(p.total, 10) AS hcp_opportunity_score,
  CAST(rank() OVER (ORDER BY p.total DESC) AS INTEGER) AS hcp_rank,
  '{formula}' AS opportunity_score_formula
FROM opp JOIN (SELECT *, {' + '.join(total)} AS total FROM parts) p USING (hcp_id)""",
        LATEST, RANKED, PROVIDER_EVENTS, PLURAL, FLAGS,
        f"parts AS (SELECT hcp_id, {', '.join(names)} FROM opp)",
    )


LINKED = f"""
tagged AS (
  SELECT e.snapshot_id, e.patient_id, e.hcp_id AS provider_id, e.event_date AS claim_date
  FROM event e
  WHERE e.status IN {VALID}
    AND (e.therapy_class = 'conventional' OR e.provider_specialty IN ('EUROPE', 'ASIA'))
    AND e.event_type LIKE 'pharmacy%')"""


def period_sql(label: str) -> str:
    return on_events(
        """
SELECT targeting_period, hcp_id, count(*) AS eligible_patient_count,
  count(*) FILTER (score >= cut) AS high_propensity_patient_count,
  count(*) FILTER (rank <= greatest(1, ceil(n * CAST(0.05 AS DOUBLE)))) AS patients_top_5pct,
  count(*) FILTER (rank <= greatest(1, ceil(n * CAST(0.1 AS DOUBLE)))) AS patients_top_10pct,
  count(*) FILTER (rank <= greatest(1, ceil(n * CAST(0.2 AS DOUBLE)))) AS patients_top_20pct,
  round(avg(score), 10) AS mean_patient_propensity,
  round(max(score), 10) AS max_patient_propensity,
  round(sum(score), 10) AS expected_switchers, round(sum(score), 10) AS hcp_opportunity_score,
  round(sum(score), 10) AS score_component__expected_switchers,
  '1*none(expected_switchers)' AS opportunity_score_formula
FROM placed JOIN winner USING (snapshot_id) GROUP BY ALL""",
        f"""
period AS (
  SELECT *, {label} AS targeting_period FROM snap
  QUALIFY row_number() OVER (PARTITION BY patient_id, targeting_period
                             ORDER BY index_date DESC, snapshot_id DESC) = 1)""",
        """
placed AS (
  SELECT *, row_number() OVER (PARTITION BY targeting_period ORDER BY score DESC, patient_id)
              AS rank,
         count(*) OVER (PARTITION BY targeting_period) AS n,
         quantile_cont(score, 0.9) OVER (PARTITION BY targeting_period) AS cut FROM period)""",
        LINKED,
        """
winner AS (
  SELECT snapshot_id, provider_id AS hcp_id
  FROM (SELECT snapshot_id, provider_id, count(*) AS c, max(claim_date) AS l
        FROM tagged GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY l DESC, c DESC, provider_id) = 1)""",
    )


FIELD = (
    LATEST,
    RANKED,
    EVENTS,
    LINKED,
    attribution_sql("most_recent_relevant_prescriber", "TRUE"),
    """
list AS (
  SELECT r.*, r.rank <= least(n, greatest(1, ceil(n * CAST(0.2 AS DOUBLE)))) AS selected, c.hcp_id
  FROM ranked r LEFT JOIN chosen c USING (patient_id))""",
    """
per AS (
  SELECT hcp_id, count(*) AS eligible_patient_count,
         count(*) FILTER (selected) AS priority_patient_count
  FROM list WHERE hcp_id IS NOT NULL GROUP BY hcp_id)""",
    """
field AS (
  SELECT CAST(row_number() OVER (ORDER BY priority_patient_count DESC, share DESC, hcp_id)
           AS INTEGER) AS hcp_rank, *, count(*) OVER () AS n
  FROM (SELECT *, CAST(round_even(100.0 * priority_patient_count
                    / CAST(eligible_patient_count AS DOUBLE), 2) AS DOUBLE) AS share
        FROM per WHERE priority_patient_count >= 1)),
target AS (
  SELECT hcp_rank, f.hcp_id, p.specialty, p.geography, p.organization, eligible_patient_count,
         priority_patient_count, share AS priority_share_percent,
         CASE WHEN hcp_rank <= greatest(1, ceil(n * CAST(0.2 AS DOUBLE))) THEN 'Tier 1'
              WHEN hcp_rank <= greatest(1, ceil(n * CAST(0.5 AS DOUBLE))) THEN 'Tier 2'
              ELSE 'Tier 3' END AS priority_tier,
         priority_patient_count || ' priority patients among ' || eligible_patient_count ||
           ' attributed eligible patients' AS targeting_reason,
         '2001-06-01' AS assessment_date
  FROM field f LEFT JOIN providers p ON p.provider_id = f.hcp_id)""",
)

VISITS = f"""
visits AS (
  SELECT CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_orderdate AS DATE) AS service_date,
         'PX' || (min(o_orderkey) % 10) AS procedure,
         list(DISTINCT o_orderpriority) FILTER (o_orderpriority IN {DX}) AS diagnoses
  FROM orders GROUP BY ALL)"""


# --- quality ----------------------------------------------------------------------------

DEFECTS = """
dmed AS (
  SELECT * REPLACE (
    CASE WHEN status = 'rejected' THEN 'x' || provider_id ELSE provider_id END AS provider_id,
    CASE WHEN status = 'rejected' THEN 'denied' ELSE status END AS status,
    available_date - 3 AS available_date) FROM med),
drx AS (
  SELECT * REPLACE (quantity - 5 AS quantity, reversal_date - 31 AS reversal_date,
                    lower(plan_id) AS plan_id) FROM rx),
denr AS (SELECT * REPLACE (coverage_end - 1300 AS coverage_end) FROM enrollment),
dmap AS (
  SELECT * REPLACE (nullif(effective_start, DATE '1998-07-01') AS effective_start) FROM mapping)"""


def violations_sql() -> str:
    rules: list[tuple[str, str, str]] = []  # (table, rule, count expression)

    def where(table: str, source: str, rule: str, cond: str) -> None:
        rules.append((table, rule, f"(SELECT count(*) FROM {source} WHERE {cond})"))

    def repeated(table: str, source: str, key: str) -> None:
        rules.append((
            table, f"{key}_repeated",
            f"(SELECT count(*) FROM (SELECT {key} FROM {source} WHERE {key} IS NOT NULL "
            f"GROUP BY {key} HAVING count(*) > 1))",
        ))

    def unknown(table: str, source: str, column: str, other: str, target: str) -> None:
        rules.append((
            table, f"{column}_unknown",
            f"(SELECT count(DISTINCT {column}) FROM {source} WHERE {column} NOT IN "
            f"(SELECT {target} FROM {other}))",
        ))

    states = "('paid', 'final', 'rejected', 'reversed')"
    for name, source, key in (("patients", "patients", "patient_id"),
                              ("medical_claims", "dmed", "claim_id"),
                              ("pharmacy_claims", "drx", "claim_id"),
                              ("providers", "providers", "provider_id"),
                              ("plans", "plans", "plan_id")):
        where(name, source, f"{key}_null", f"{key} IS NULL")
        repeated(name, source, key)
    for name, source in (("medical_claims", "dmed"), ("pharmacy_claims", "drx"),
                         ("enrollment", "denr")):
        where(name, source, "patient_id_null", "patient_id IS NULL")
        unknown(name, source, "patient_id", "patients", "patient_id")
    for name, source, columns in (
        ("patients", "patients", ("observation_start", "observation_end")),
        ("medical_claims", "dmed", ("claim_date", "available_date")),
        ("pharmacy_claims", "drx", ("fill_date", "available_date")),
        ("enrollment", "denr", ("coverage_start", "coverage_end")),
        ("therapy_mapping", "dmap", ("effective_start", "effective_end")),
    ):
        for c in columns:
            where(name, source, f"{c}_null", f"{c} IS NULL")
        if "available_date" not in columns:
            a, b = columns
            where(name, source, f"{a}_after_{b}", f"{a} > {b}")
    for name, source, day in (("medical_claims", "dmed", "claim_date"),
                              ("pharmacy_claims", "drx", "fill_date")):
        where(name, source, "status_unsupported", f"status NOT IN {states}")
        where(name, source, "availability_precedes_service", f"available_date < {day}")
    where("pharmacy_claims", "drx", "reversal_precedes_availability",
          "reversal_date < available_date")
    for c in ("days_supply", "quantity", "patient_cost"):
        where("pharmacy_claims", "drx", f"{c}_negative_or_missing", f"{c} IS NULL OR {c} < 0")
    where("pharmacy_claims", "drx", "days_supply_fractional", "days_supply % 1 <> 0")
    unknown("medical_claims", "dmed", "provider_id", "providers", "provider_id")
    unknown("pharmacy_claims", "drx", "prescriber_id", "providers", "provider_id")
    unknown("pharmacy_claims", "drx", "plan_id", "plans", "plan_id")
    unknown("enrollment", "denr", "plan_id", "plans", "plan_id")
    body = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{r}' AS rule, CAST({e} AS BIGINT) AS violations"
        for t, r, e in rules
    )
    return with_tables(body, DEFECTS)


# fixed values: columns of each canonical table, in contract order, and its date columns
PROFILED = {
    "patients": ("patients", "patient_id birth_year gender geography observation_start "
                 "observation_end", "observation_start observation_end"),
    "medical_claims": ("med", "claim_id patient_id claim_date available_date status "
                       "diagnosis_code procedure_code provider_id place_of_service",
                       "claim_date available_date"),
    "pharmacy_claims": ("rx", "claim_id patient_id fill_date available_date status reversal_date "
                        "drug_id therapy_class quantity days_supply prescriber_id plan_id "
                        "patient_cost", "fill_date available_date"),
    "providers": ("providers", "provider_id specialty geography organization", ""),
    "plans": ("plans", "plan_id payer_type", ""),
    "enrollment": ("enrollment", "patient_id coverage_start coverage_end plan_id",
                   "coverage_start coverage_end"),
    "therapy_mapping": ("mapping", "drug_id therapy_class effective_start effective_end",
                        "effective_start effective_end"),
}


def profile_sql() -> str:
    parts = []

    def add(table, measure, column, value, source):
        parts.append(
            f"SELECT '{table}' AS \"table\", '{measure}' AS measure, '{column}' AS \"column\", "
            f"CAST({value} AS VARCHAR) AS value FROM {source}"
        )

    for table, (source, columns, dates) in PROFILED.items():
        add(table, "rows", "", "count(*)", source)
        for c in columns.split():
            add(table, "nulls", c, f"count(*) - count({c})", source)
        if "patient_id" in columns:
            add(table, "distinct", "patient_id", "count(DISTINCT patient_id)", source)
        for c in dates.split():
            add(table, "min", c, f"min({c})", source)
            add(table, "max", c, f"max({c})", source)
        if "status" in columns.split():
            parts.append(
                f"SELECT '{table}', 'status', status, CAST(count(*) AS VARCHAR) FROM {source} "
                f"GROUP BY status"
            )
    return with_tables(" UNION ALL ".join(parts))


DIGESTED = {
    "patients": "patients", "medical_claims": "med", "pharmacy_claims": "rx",
    "providers": "providers", "plans": "plans", "enrollment": "enrollment",
    "therapy_mapping": "mapping",
}
COLUMNS = {
    "patients": "birth_year gender geography observation_end observation_start patient_id",
    "medical_claims": "available_date claim_date claim_id diagnosis_code patient_id "
    "place_of_service procedure_code provider_id status",
    "pharmacy_claims": "available_date claim_id days_supply drug_id fill_date patient_cost "
    "patient_id plan_id prescriber_id quantity reversal_date status therapy_class",
    "providers": "geography organization provider_id specialty",
    "plans": "payer_type plan_id",
    "enrollment": "coverage_end coverage_start patient_id plan_id",
    "therapy_mapping": "drug_id effective_end effective_start therapy_class",
}


def digest_sql() -> str:
    parts = []
    for name, cte in DIGESTED.items():
        columns = COLUMNS[name].split()
        row = " || ".join(
            f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
            for c in columns
        )
        parts.append(f"""
SELECT count(*) AS rows, sha256('{','.join(columns)}|' || count(*) || '|' || coalesce(sum(CAST(
    '0x' || substr(md5({row}), 1, 15) AS BIGINT)), 0)) AS content_digest, '{name}' AS "table"
FROM {cte}""")
    return with_tables("\nUNION ALL".join(parts))


def audit_sql() -> str:
    """The profile without distinct counts, states by name, and the content digest."""
    profile = profile_sql().replace(" UNION ALL ", "\nUNION ALL\n")
    head, _, body = profile.partition("\nSELECT ")
    parts = [p for p in ("SELECT " + body).split("\nUNION ALL\n") if "'distinct' AS" not in p]
    parts = [p for p in parts if "'status', status" not in p]
    dated = {"pharmacy_claims": ("rx", ("reversal_date",))}
    for table, source in (("medical_claims", "med"), ("pharmacy_claims", "rx")):
        for status in ("paid", "final", "rejected", "reversed"):
            parts.append(
                f"SELECT '{table}', 'status', '{status}', CAST(count(*) FILTER (status = '{status}') "
                f"AS VARCHAR) FROM {source}"
            )
        parts.append(f"SELECT '{table}', 'status', 'other', '0' FROM {source} LIMIT 1")
    for table, (source, dates) in dated.items():
        for c in dates:
            parts += [f"SELECT '{table}', '{f}', '{c}', CAST({f}({c}) AS VARCHAR) FROM {source}" for f in ("min", "max")]
    digests = digest_sql().partition("\nSELECT count(*) AS rows")
    parts.append(
        "SELECT \"table\", 'digest', '', content_digest FROM (SELECT count(*) AS rows" + digests[2] + ")"
    )
    return head + "\n" + "\nUNION ALL\n".join(f"({p})" for p in parts)


ORACLE: dict[str, str] = {
    "profile_tables": profile_sql(),
    "medical_grain": with_tables("""
SELECT count(*) AS rows, count(DISTINCT claim_id) AS distinct_claim_lines,
  count(DISTINCT patient_id) AS patients, count(*) - count(patient_id) AS missing_patient,
  count(*) - count(claim_date) AS missing_service_date,
  count(*) - count(available_date) AS missing_availability,
  count(*) FILTER (available_date < claim_date) AS availability_before_service,
  min(claim_date) AS first_service_date, max(claim_date) AS last_service_date FROM med"""),
    "diagnosis_frequency": """
SELECT o_orderpriority AS diagnosis_code, count(*) AS rows,
  count(DISTINCT o_custkey) AS patients FROM orders GROUP BY 1 ORDER BY rows DESC""",
    "pharmacy_status": with_tables("""
SELECT status, count(*) AS rows, count(DISTINCT claim_id) AS distinct_claim_lines,
  count(DISTINCT patient_id) AS patients, count(*) - count(drug_id) AS missing_product,
  count(*) FILTER (days_supply IS NULL OR days_supply < 0) AS invalid_supply,
  min(fill_date) AS first_fill_date, max(fill_date) AS last_fill_date FROM rx GROUP BY status"""),
    "drug_id_shape": """
SELECT CAST(length(CAST(l_partkey AS VARCHAR)) AS INTEGER) AS product_code_length,
  count(*) AS rows FROM lineitem GROUP BY 1""",
    "mapping_multiplicity": with_tables("""
SELECT claim_id, count(m.drug_id) AS applicable_mappings FROM rx p LEFT JOIN mapping m
  ON p.drug_id = m.drug_id AND p.fill_date BETWEEN m.effective_start AND m.effective_end + 1
GROUP BY claim_id HAVING count(m.drug_id) <> 1"""),
    "mapping_overlap": with_tables("""
SELECT b.drug_id, b.effective_start, b.effective_end + 1 AS effective_end,
  max(a.effective_end + 1) AS previous_end, CAST(1 AS BIGINT) AS rows
FROM mapping a JOIN mapping b ON a.drug_id = b.drug_id AND a.effective_start < b.effective_start
WHERE b.effective_start <= a.effective_end + 1 GROUP BY 1, 2, 3"""),
    "enrollment_quality": with_tables("""
SELECT count(*) AS rows, count(DISTINCT patient_id) AS patients,
  count(*) FILTER (coverage_start IS NULL OR coverage_end IS NULL) AS missing_dates,
  count(*) FILTER (coverage_end < coverage_start) AS reversed_intervals FROM enrollment"""),
    "table_violations": violations_sql(),
    "csv_safe": """
SELECT p_partkey, CASE WHEN ltrim(name)[1] IN ('=', '+', '-', '@') THEN '''' || name ELSE name END
  AS name, p_brand
FROM (SELECT p_partkey, ['=', '+', '-', '@', ' =', '', ''''][p_partkey % 7 + 1] || p_name AS name,
        p_brand FROM part)""",
    "effective_mapping": with_tables("""
SELECT claim_id, patient_id, fill_date, p.drug_id, m.therapy_class
FROM rx p JOIN mapping m ON p.drug_id = m.drug_id AND p.therapy_class = m.therapy_class
  AND p.fill_date >= m.effective_start AND p.fill_date <= m.effective_end"""),
    "known_claims_asof": with_tables(f"""
SELECT patient_id, CASE WHEN reversal_date <= DATE '1999-07-01' THEN 'reversed' ELSE status END
    AS status, count(*) AS claims, max(fill_date) AS last_fill,
  count(*) FILTER (CASE WHEN reversal_date <= DATE '1999-07-01' THEN 'reversed' ELSE status END
    IN {VALID}) AS valid_claims
FROM rx WHERE fill_date <= DATE '1999-06-24' AND available_date <= DATE '1999-07-01'
GROUP BY ALL"""),
    "coverage_union": with_tables(f"""
SELECT p.patient_id, CAST(count(day) AS INTEGER) AS covered_days,
  CAST(CASE WHEN count(day) = 0 THEN 365 ELSE greatest(max(gap), DATE '1998-12-31' - max(day)) END
    AS INTEGER) AS maximum_gap_days,
  coalesce(max(day) = DATE '1998-12-31', FALSE) AS covered_last_day
FROM patients p LEFT JOIN (
  SELECT patient_id, day, day - lag(day, 1, DATE '1997-12-31') OVER (
    PARTITION BY patient_id ORDER BY day) - 1 AS gap
  FROM (SELECT DISTINCT patient_id, fill_date + CAST(i AS INTEGER) AS day
        FROM (SELECT *, unnest(range(0, days_supply)) AS i FROM rx WHERE status IN {VALID})
        WHERE fill_date + CAST(i AS INTEGER) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31')) d
  USING (patient_id)
GROUP BY p.patient_id"""),
    "enrollment_islands": with_tables("""
SELECT a.patient_id, a.coverage_start AS island_start,
  (SELECT min(e.coverage_end) FROM enrollment e WHERE e.patient_id = a.patient_id
     AND e.coverage_end >= a.coverage_start AND NOT EXISTS (
       SELECT 1 FROM enrollment n WHERE n.patient_id = e.patient_id
         AND n.coverage_start <= e.coverage_end + 1 AND n.coverage_end > e.coverage_end))
    AS island_end
FROM enrollment a WHERE NOT EXISTS (
  SELECT 1 FROM enrollment b WHERE b.patient_id = a.patient_id
    AND b.coverage_start < a.coverage_start AND b.coverage_end + 1 >= a.coverage_start)"""),
    "candidates": with_tables("SELECT patient_id, t AS index_date FROM cand", CANDIDATES),
    "candidates_provided": with_tables("""
SELECT patient_id, CAST(DATE '1998-01-01' + CAST(CAST(patient_id AS INTEGER) % 31 AS INTEGER)
  + to_months(CAST(i AS INTEGER)) AS DATE) AS index_date
FROM patients, range(0, 3) g(i)"""),
    "cohort_labels": on_cohort("""
SELECT snapshot_id, patient_id, 'generated' AS cohort_id, start_dt, index_date, feature_cutoff,
  lookback_start, prediction_end, label_available_date, label AS resp, label, outcome_date,
  TRUE AS eligible, TRUE AS followup_complete, covered_days, maximum_gap_days FROM snap"""),
    "cohort_exclusions": on_cohort("""
SELECT snapshot_id, patient_id, t AS index_date, reason FROM facts WHERE reason IS NOT NULL"""),
    "exclusion_counts": on_cohort("""
SELECT reason, count(*) AS snapshots FROM facts WHERE reason IS NOT NULL GROUP BY reason"""),
    "cohort_written": on_cohort("""
SELECT snapshot_id, patient_id, t AS index_date, coalesce(reason, 'eligible') AS reason FROM facts"""),
    "audit_cohort": on_cohort("""
SELECT 'cohort' AS "table", 'rows' AS measure, '' AS "column", CAST(count(*) AS VARCHAR) AS value
FROM facts
UNION ALL
SELECT 'cohort', 'outcome', name, CAST(count(snapshot_id) AS VARCHAR)
FROM (SELECT unnest(['eligible', 'future_index', 'immature_label',
  'insufficient_observation_or_enrollment', 'diagnosis_not_confirmed', 'no_conventional_exposure',
  'insufficient_conventional_coverage', 'no_conventional_coverage_on_index', 'conventional_gap',
  'known_prior_advanced']) AS name)
LEFT JOIN facts ON name = coalesce(reason, 'eligible') GROUP BY name"""),
    "scoring_cohort": on_live("""
SELECT snapshot_id, patient_id, 'generated' AS cohort_id, start_dt, index_date, feature_cutoff,
  lookback_start, prediction_end, TRUE AS eligible, covered_days, maximum_gap_days FROM snap"""),
    "timeline_differences": on_cohort("""
SELECT snapshot_id, patient_id, index_date, label, outcome_date + 1 AS outcome_date,
  label_available_date, 'supplied' AS side FROM snap WHERE label = 1
UNION ALL
SELECT snapshot_id, patient_id, index_date, label, outcome_date, label_available_date, 'derived'
FROM snap WHERE label = 1"""),
    "events": on_events("""
SELECT *, CAST(coalesce(event_date - lag(event_date) OVER w, 0) AS INTEGER)
    AS time_since_previous_event,
  CAST(row_number() OVER w - 1 AS INTEGER) AS event_order
FROM event WINDOW w AS (PARTITION BY snapshot_id ORDER BY event_date, event_id)"""),
    "features_counts": on_events("SELECT * FROM counts", counts_sql()),
    "features_coverage": on_cohort(
        f"SELECT snapshot_id, {COVERAGE_COLUMNS.format(p=6)} FROM covered", COVER_DAYS
    ),
    "features_therapy": on_cohort("SELECT * FROM therapy", COVER_DAYS, THERAPY),
    "features_peers": on_cohort("SELECT * FROM peers", COVER_DAYS, THERAPY, PEERS),
    "features_payer": on_cohort("SELECT * FROM payer", PAYER),
    "features_wide": wide_sql(),
    "history_vocab": on_events(
        "SELECT history_token, events FROM vocab WHERE i < 24", TOKENS
    ),
    "history_features": history_sql(),
    "sequence_vocab": on_events("SELECT * FROM voc", VOCABULARY),
    "sequence_tail": on_events("""
SELECT snapshot_id, event_id, event_date, delta AS time_since_previous_event, position
FROM tail""", TAIL),
    "sequence_encoded": encoded_sql(),
    "sequence_split": on_events("""
SELECT s.snapshot_id, CAST(coalesce(sum(a), 0) AS BIGINT) AS channel_0,
  CAST(coalesce(sum(b), 0) AS BIGINT) AS channel_1,
  CAST(coalesce(sum(c), 0) AS BIGINT) AS channel_2,
  CAST(coalesce(sum(d), 0) AS BIGINT) AS channel_3,
  CAST(coalesce(sum(days_before_index), 0) AS BIGINT) AS channel_4
FROM snap s LEFT JOIN coded USING (snapshot_id) GROUP BY s.snapshot_id""",
        VOCABULARY, TAIL, CODED),
    "sequence_violations": on_events("""
SELECT unnest(['wrong_size', 'not_right_padded', 'negative_time', 'missing_index_date',
  'missing_event_date', 'post_index_event', 'unavailable_event', 'not_chronological']) AS rule,
  CAST(0 AS BIGINT) AS violations
UNION ALL
SELECT 'token_out_of_range', count(DISTINCT snapshot_id) FROM coded
WHERE a >= (SELECT max(id) FROM voc WHERE vocab_key = 'event_type')
   OR b >= (SELECT max(id) FROM voc WHERE vocab_key = 'code')
   OR c >= (SELECT max(id) FROM voc WHERE vocab_key = 'therapy_class')
   OR d >= (SELECT max(id) FROM voc WHERE vocab_key = 'specialty')""", VOCABULARY, TAIL, CODED),
    "temporal_split": on_cohort("""
SELECT snapshot_id, patient_id, index_date, label, split FROM split""", SPLIT),
    "temporal_cuts": on_cohort("""
SELECT (SELECT count(*) FROM snap) AS snapshots,
  (SELECT list(f ORDER BY f)[CAST(trunc((count(*) - 1) * CAST(0.6000000000000001 AS DOUBLE))
     AS BIGINT) + 1] FROM firsts) AS train_end,
  (SELECT list(f ORDER BY f)[CAST(trunc((count(*) - 1) * CAST(0.8 AS DOUBLE)) AS BIGINT) + 1]
   FROM firsts) AS validation_end""",
        "firsts AS (SELECT min(index_date) AS f FROM snap GROUP BY patient_id)"),
    "split_manifest": on_cohort("""
SELECT snapshot_id, patient_id, index_date, label_available_date, label,
  coalesce(split, 'purged') AS split, CASE WHEN split IS NULL
    THEN 'patient assignment, temporal gap or label maturity' ELSE 'retained' END AS reason
FROM split""", SPLIT),
    "split_counts": on_cohort("""
SELECT split, count(DISTINCT patient_id) AS patients, count(*) AS snapshots,
  CAST(sum(label) AS BIGINT) AS positive_snapshots
FROM split WHERE split IS NOT NULL GROUP BY split""", SPLIT),
    "stratified_split": on_cohort("""
SELECT snapshot_id, patient_id, CASE
    WHEN place <= floor(size * CAST(0.6000000000000001 AS DOUBLE)) THEN 'train'
    WHEN place <= floor(size * CAST(0.8 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split
FROM snap JOIN (
  SELECT patient_id, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || patient_id),
           patient_id) AS place, count(*) OVER (PARTITION BY y) AS size
  FROM (SELECT patient_id, max(label) AS y FROM snap GROUP BY patient_id)) USING (patient_id)"""),
    "latest_snapshot": on_cohort("""
SELECT patient_id, snapshot_id, index_date FROM snap s WHERE index_date = (
  SELECT max(index_date) FROM snap z WHERE z.patient_id = s.patient_id
    AND z.index_date <= DATE '1999-07-01')"""),
    "rank_patients": on_cohort("""
SELECT patient_id, snapshot_id, index_date, score AS risk_score, CAST(rank AS INTEGER) AS rank,
  rank <= least(n, greatest(1, ceil(n * CAST(0.1 AS DOUBLE)))) AS selected
FROM ranked""", LATEST, RANKED),
    "capture_metrics": on_cohort(f"""
SELECT n AS patients, positives, k AS selected, captured,
  round(captured / CAST(positives AS DOUBLE), 6) AS recall,
  round(captured / CAST(k AS DOUBLE), 6) AS precision,
  round(captured / CAST(k AS DOUBLE) / (positives / CAST(n AS DOUBLE)), 6) AS lift,
  round({AP}, 6) AS ap
FROM (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
        CAST(ceil(count(*) * CAST(0.1 AS DOUBLE)) AS BIGINT) AS k,
        CAST(sum(label) FILTER (rank <= ceil(n * CAST(0.1 AS DOUBLE))) AS BIGINT) AS captured
      FROM ranked)""", LATEST, RANKED),
    "class_metrics": on_cohort(
        f"SELECT {CLASS_COLUMNS} FROM curve", LATEST,
        "cuts AS (SELECT CAST(0.5 AS DOUBLE) AS threshold)", threshold_values()),
    "ranking_metrics": on_cohort(
        top_metrics((0.01, 0.05, 0.10, 0.20, 0.30)), LATEST, RANKED),
    "evaluate_predictions": on_cohort(
        f"SELECT {CLASS_COLUMNS.replace(CURVE_COLUMNS, CURVE_COLUMNS.replace('round(', 'round(curve.'))}, " + ", ".join(
            f"{a}.recall AS recall_at_{p}pct, {a}.precision AS precision_at_{p}pct, "
            f"{a}.lift AS lift_at_{p}pct, CAST({a}.selected_positives AS DOUBLE) AS truepositives_at_{p}pct"
            for a, p in zip("abcde", (1, 5, 10, 20, 30), strict=True)
        )
        + " FROM (SELECT * FROM curve) curve, tops a, tops b, tops c, tops d, tops e "
        "WHERE a.at = '1%' AND b.at = '5%' AND c.at = '10%' AND d.at = '20%' AND e.at = '30%'",
        LATEST, RANKED, "cuts AS (SELECT CAST(0.5 AS DOUBLE) AS threshold)",
        threshold_values(), f"tops AS ({top_metrics((0.01, 0.05, 0.1, 0.2, 0.3))})"),
    "prediction_problems": on_cohort("""
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS bad_label, CAST(0 AS BIGINT) AS bad_score,
  count(*) FILTER (score * 2 - 0.5 NOT BETWEEN 0 AND 1) AS outside_unit FROM snap"""),
    "threshold_tuning": tuning_sql(),
    "threshold_grid": on_cohort(
        f"SELECT round(threshold, 6) AS threshold, {CURVE_COLUMNS}, rows FROM curve", LATEST,
        "cuts AS (SELECT i / CAST(20 AS DOUBLE) AS threshold FROM range(0, 21) g(i))",
        threshold_values()),
    "class_imbalance": on_cohort("""
SELECT p AS positive_patients, n - p AS negative_patients,
  round(p / CAST(n AS DOUBLE), 6) AS positive_prevalence,
  p || ':' || (n - p) AS positive_to_negative_ratio,
  round(p / nullif(CAST(n - p AS DOUBLE), 0), 6) AS positive_negative_ratio_numeric,
  round((n - p) / nullif(CAST(p AS DOUBLE), 0), 6) AS positive_class_weight
FROM (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM snap)"""),
    "attribution_recent": with_tables("SELECT * FROM chosen", PROVIDER_EVENTS, attribution_sql(
        "most_recent_relevant_prescriber", "role = 'prescriber'")),
    "attribution_plurality": with_tables("SELECT * FROM chosen", PROVIDER_EVENTS, PLURAL),
    "attribution_specialist": with_tables("SELECT * FROM chosen", PROVIDER_EVENTS, attribution_sql(
        "most_frequent_relevant_specialist", "specialty IN ('EUROPE', 'ASIA')")),
    "attribution_existing": with_tables("""
SELECT patient_id,
  CASE WHEN mine THEN CAST(CAST(patient_id AS BIGINT) % 10 AS VARCHAR) ELSE hcp_id END AS hcp_id,
  CASE WHEN mine THEN 'existing_attribution' ELSE attribution_method END AS attribution_method,
  CASE WHEN NOT mine THEN attribution_claim_count END AS attribution_claim_count,
  CASE WHEN NOT mine THEN attribution_last_date END AS attribution_last_date
FROM (SELECT patient_id, plan_id IN ('BUILDING', 'AUTOMOBILE') AS mine
      FROM (SELECT DISTINCT patient_id, plan_id FROM enrollment))
LEFT JOIN chosen USING (patient_id) WHERE mine OR hcp_id IS NOT NULL""", PROVIDER_EVENTS, PLURAL),
    "hcp_opportunity": on_cohort(
        "SELECT * FROM opp", LATEST, RANKED, PROVIDER_EVENTS, PLURAL, FLAGS),
    "hcp_score": score_sql("minmax"),
    "hcp_score_percentile": score_sql("percentile"),
    "hcp_by_month": period_sql("strftime(index_date, '%Y-%m')"),
    "hcp_by_quarter": period_sql("year(index_date) || 'Q' || quarter(index_date)"),
    "field_targets": on_live("SELECT * FROM target", *FIELD),
    "field_coverage": on_live("""
SELECT count(*) AS eligible_patients, count(*) FILTER (selected) AS priority_patients,
  count(hcp_id) AS attributed_patients,
  count(*) FILTER (hcp_id IS NULL) AS unattributed_patients,
  count(*) FILTER (hcp_id IS NULL AND selected) AS unattributed_priority_patients,
  count(*) FILTER (selected AND hcp_id IN (
    SELECT hcp_id FROM per WHERE priority_patient_count >= 2)) AS exported_priority_patients,
  count(*) FILTER (selected AND hcp_id IN (
    SELECT hcp_id FROM per WHERE priority_patient_count < 2)) AS withheld_priority_patients
FROM list""", *FIELD),
    "target_view": on_live("""
SELECT * FROM target
WHERE specialty = 'EUROPE' AND lower(hcp_id || ' ' || organization) LIKE '%supplier%'
ORDER BY eligible_patient_count DESC, hcp_rank LIMIT 12""", *FIELD),
    "diagnosis_explode": f"""
WITH {VISITS}, lines AS (
  SELECT *, o_orderpriority AS code FROM visits v LEFT JOIN (
    SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS patient_id,
      CAST(o_orderdate AS DATE) AS service_date, o_orderpriority FROM orders
    WHERE o_orderpriority IN {DX}) USING (patient_id, service_date))
SELECT patient_id || '-' || service_date || ':' ||
    CASE WHEN code IS NULL THEN 'none' ELSE CAST(pos AS VARCHAR) END AS claim_id,
  patient_id, service_date, code AS diagnosis_code,
  CASE WHEN pos = 0 THEN procedure END AS procedure_code
FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, service_date ORDER BY code) - 1 AS pos
      FROM lines)""",
    "patient_scope": with_tables("""
SELECT patient_id, count(*) AS fills FROM rx
WHERE fill_date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' AND patient_id IN (
  SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT'
    AND CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-06-28')
GROUP BY patient_id"""),
    "post_index_events": with_tables("""
SELECT claim_id, patient_id, claim_date, DATE '1999-07-01' AS index_date FROM med
WHERE claim_date > DATE '1999-07-01'"""),
    "event_timing": on_events("""
SELECT * FROM (
  SELECT 'snapshots' AS "table", 'outcome_outside_window' AS rule,
    count(*) FILTER (outcome_date - 60 <= index_date) AS violations FROM snap
  UNION ALL
  SELECT 'snapshots', 'start_after_cutoff', count(*) FILTER (start_dt > feature_cutoff - 20)
  FROM snap
  UNION ALL
  SELECT 'wide', 'feature_as_of_after_index', count(*) FROM snap
  UNION ALL
  SELECT 'events', 'after_cutoff', count(*) FILTER (event_date > index_date - 27) FROM event)
WHERE violations > 0"""),
    "scoring_violations": on_live("""
SELECT 'snapshots' AS "table", 'cutoff_exceeds_lag' AS rule, count(*) AS violations FROM snap"""),
    "exact_medians": on_cohort("""
SELECT 'covered_days' AS name, CAST(quantile_cont(covered_days, 0.5) AS DOUBLE) AS value FROM snap
UNION ALL
SELECT 'maximum_gap_days', CAST(quantile_cont(maximum_gap_days, 0.5) AS DOUBLE) FROM snap"""),
}
def _split_sql() -> str:
    rows = [
        ("train", 0, 0, 0, "0", "0"),
        ("validation", 0, 1, 0, "0", "0"),
        ("test", 1, 0, 1, "0", "(SELECT count(*) FROM parts WHERE split = 'test' AND label = 1)"),
        ("later", 0, 0, 0, "1", "0"),
    ]
    names = ("feature_names_or_order", "feature_types", "forbidden_features", "empty", "label_not_binary")
    lines = [
        f"SELECT '{name}' AS \"table\", '{rule}' AS rule, CAST({n} AS BIGINT) AS violations"
        for name, *values in rows
        for rule, n in zip(names, values, strict=True)
    ]
    return "\nUNION ALL\n".join(lines)


def matrix_sql() -> str:
    """All predictors unpivoted, after the two gaps were filled by median and mode."""
    wide = ORACLE["features_wide"]
    head, _, body = wide.rpartition("\nSELECT s.snapshot_id, s.index_date AS feature_as_of")
    texts = ("gender", "current_therapy", "geography", "payer_type")
    numbers = [
        "age", "proportion_days_covered", "maximum_therapy_gap_days", "therapy_changes",
        "therapies_tried", "therapy_duration_days",
        *[f"{c}_{w}d" for w in WINDOWS for c in (
            "diagnosis_count", "procedure_count", "pharmacy_count", "specialist_visits",
            "emergency_visits", "urgent_visits", "rejected_rx", "reversed_rx", "patient_cost")],
        "days_since_last_diagnosis", "days_since_last_specialist", "days_since_last_rx",
        "days_since_last_treatment_change", "diagnosis_acceleration", "diagnosis_recent_prior_ratio",
        "specialist_acceleration", "specialist_recent_prior_ratio", "recent_coverage_90d",
        "previous_coverage_90d", "coverage_change", "symptom_count", "comorbidity_count",
        "hcp_historical_advanced_patients", "hcp_historical_patients",
    ]
    cells = [f"SELECT snapshot_id, {k} AS position, CAST({c} AS DOUBLE) AS value FROM filled" for k, c in enumerate(numbers)]
    cells += [
        f"SELECT snapshot_id, {len(numbers) + 128 * k} + CAST(CAST('0x' || substr(md5('{c}=' || {c}), 1, 8) AS BIGINT) "
        f"% 128 AS INTEGER), 1.0 FROM filled"
        for k, c in enumerate(texts)
    ]
    return head + f""",
wide AS (SELECT s.snapshot_id, s.index_date AS feature_as_of{body}),
gaps AS (
  SELECT * REPLACE (nullif(age, 40) AS age, CASE WHEN therapies_tried > 1 THEN gender END AS gender)
  FROM wide),
filled AS MATERIALIZED (
  SELECT * REPLACE (coalesce(age, (SELECT quantile_cont(age, 0.5) FROM gaps)) AS age,
    coalesce(gender, (SELECT gender FROM gaps WHERE gender IS NOT NULL GROUP BY gender
                      ORDER BY count(*) DESC, gender LIMIT 1)) AS gender) FROM gaps)
SELECT snapshot_id, position, round(value, 4) AS value
FROM (""" + "\nUNION ALL ".join(cells) + ") WHERE value <> 0"


ORACLE |= {
    "audit_tables": audit_sql(),
    "model_matrix": matrix_sql(),
    "manifest_changes": with_tables("""
SELECT 'providers' AS "table", 'added' AS state, CAST(count(*) AS BIGINT) AS rows
FROM providers WHERE geography = 'FRANCE' HAVING count(*) > 0
UNION ALL
SELECT 'plans', state, count(*) FROM plans, (SELECT unnest(['added', 'missing']) AS state)
GROUP BY state"""),
    "event_date_violations": with_tables("""
SELECT 'events' AS "table", 'event_undated' AS rule, count(*) AS violations FROM med
WHERE claim_date IS NULL OR CAST(patient_id AS BIGINT) % 5 = 0
UNION ALL
SELECT 'events', 'event_after_index', count(*) FROM med
WHERE claim_date > DATE '1999-07-01' AND CAST(patient_id AS BIGINT) % 5 > 0
UNION ALL
SELECT 'events', 'patient_id_ambiguous', count(*) FROM patients
WHERE CAST(patient_id AS BIGINT) % 5 > 0 AND CAST(patient_id AS BIGINT) % 7 = 0"""),
    "feature_violations": on_cohort("""
SELECT 'wide' AS "table", 'label_forbidden' AS rule, CAST(1 AS BIGINT) AS violations
UNION ALL
SELECT 'wide', 'covered_infinite', CAST(sum(1 + label) AS BIGINT) FROM snap WHERE maximum_gap_days > 100
UNION ALL
SELECT 'wide', 'label_infinite', 0
UNION ALL
SELECT 'wide', 'snapshot_id_repeated', count(*) FROM snap WHERE label = 1"""),
    "sequence_split_violations": on_cohort("""
SELECT "table", rule, CAST(CASE
    WHEN "table" = 'test' AND rule = 'rows_without_target' THEN even_ones
    WHEN "table" = 'validation' AND rule = 'targets_without_row' THEN odd_ones
    WHEN "table" = 'validation' AND rule IN ('length_differs', 'channels_differ') THEN 1
    WHEN "table" = 'train' AND rule = 'channels_differ' THEN 1 ELSE 0 END AS BIGINT) AS violations
FROM (SELECT count(*) FILTER (month(index_date) % 10 % 2 = 0 AND label = 1) AS even_ones,
             count(*) FILTER (month(index_date) % 10 % 2 = 1 AND label = 1) AS odd_ones FROM snap),
     (SELECT unnest(['train', 'validation', 'test']) AS "table"),
     (SELECT unnest(['empty', 'length_differs', 'channels_differ', 'rows_without_target',
                     'targets_without_row']) AS rule)"""),
    "tabular_split_violations": on_cohort(_split_sql(), SPLIT, "parts AS (SELECT * FROM split)"),
    "field_file": on_live("""
SELECT 'field' AS "table", rule, CAST(CASE rule WHEN 'rows' THEN n ELSE 0 END AS BIGINT) AS violations
FROM (SELECT count(*) AS n FROM target),
     (SELECT unnest(['row_out_of_order', 'file_overlaps', 'rank_repeated', 'rows']) AS rule)""", *FIELD),
    "content_digest": digest_sql(),
    "cohort_hot": ORACLE["cohort_labels"],
    "features_counts_hot": ORACLE["features_counts"],
    "features_peers_hot": ORACLE["features_peers"],
}
