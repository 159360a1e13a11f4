"""SQL for DuckDB that gives the rows of each registered query."""

from __future__ import annotations

K, ROUNDS, FAST, FULL, NPROBES = 16, 3, 2, 4, [1, 2, 4, 8, 16]
#: Lists that searches over a stored index probe: recall is 0.9 or more (tests measure it).
DEEP = 12

# --- payload features -------------------------------------------------------

PAYLOADS = """
p0 AS (
  SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events
), p AS (
  SELECT event_id, event_type, value, sec, k,
    CAST(sum(cents) OVER (PARTITION BY user_id) AS DOUBLE) / count(*) OVER (PARTITION BY user_id) / 100.0::DOUBLE AS user_avg,
    CAST(sum(cents) OVER (PARTITION BY event_type) AS DOUBLE) / count(*) OVER (PARTITION BY event_type) / 100.0::DOUBLE AS kind_avg,
    count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n_day,
    lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS last_sec
  FROM p0
)"""


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0::FLOAT), 1::FLOAT)"


def _scaled(x: str, limit: int) -> str:
    return _clamp(f"CAST({x} AS FLOAT) * CAST(1.0::DOUBLE / {limit} AS FLOAT)")


_TIME = "make_timestamp(sec * 1000000)"
# Risks of the categories that the adapter gives the event types.
_RISK = "CASE event_type WHEN 'click' THEN 0.15 WHEN 'view' THEN 0.30 WHEN 'purchase' THEN 0.85 ELSE 0.5 END"
_MINUTES = "CAST(CAST(sec - last_sec AS FLOAT) / 60::FLOAT AS FLOAT)"
_RATIO = "CAST(CAST(value AS FLOAT) / CAST(user_avg AS FLOAT) AS FLOAT)"
FEATURES = [
    _scaled("value", 10000),
    _scaled("k % 15", 12),
    f"CASE WHEN CAST(user_avg AS FLOAT) > 0 THEN {_clamp(f'{_RATIO} * CAST(1.0::DOUBLE / 10 AS FLOAT)')} ELSE 0 END",
    f"CAST(hour({_TIME}) AS FLOAT) * CAST(1.0::DOUBLE / 23 AS FLOAT)",
    f"CAST(isodow({_TIME}) - 1 AS FLOAT) * CAST(1.0::DOUBLE / 6 AS FLOAT)",
    f"CASE WHEN last_sec IS NULL THEN -1 ELSE {_clamp(f'{_MINUTES} * CAST(1.0::DOUBLE / 1440 AS FLOAT)')} END",
    f"CASE WHEN last_sec IS NULL THEN -1 ELSE {_scaled('k * 11.5::DOUBLE', 1000)} END",
    _scaled("k * 12.5::DOUBLE", 1000),
    _scaled("n_day", 20),
    "CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END",
    "CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END",
    "CASE WHEN list_contains(['click', 'view', 'signup'], event_type) THEN 0 ELSE 1 END",
    f"CAST({_RISK} AS FLOAT)",
    _scaled("kind_avg", 10000),
]


def _feature_sql(dims: list[int]) -> str:
    columns = ", ".join(f"CAST(CAST({FEATURES[d]} AS FLOAT) AS DOUBLE) AS f{d}" for d in dims)
    return f"WITH {PAYLOADS}\nSELECT event_id, {columns} FROM p"


def _vector_sql() -> str:
    every = ", ".join(f"CAST({f} AS FLOAT)" for f in FEATURES)
    return f"""WITH {PAYLOADS}, v AS (SELECT event_id, [{every}] AS x FROM p)
SELECT event_id, CAST(i - 1 AS INTEGER) AS dim, CAST(x[i] AS DOUBLE) AS value FROM (SELECT event_id, x, unnest(range(1, 15)) AS i FROM v)"""


# --- vectors ----------------------------------------------------------------


def _round(x: str) -> str:
    return f"CAST(least(greatest(round({x}), -16383), 16383) AS BIGINT)"


def _distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


BASE = """
r AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, CASE WHEN label < 3 THEN 1 ELSE 0 END AS label FROM embeddings
), am AS (
  SELECT max(list_max(list_transform(e, lambda x: abs(x)))) AS largest FROM r
)"""
QUANT = f"""{BASE}, s AS (SELECT largest, 16383::DOUBLE / largest AS scale FROM am), q AS (
  SELECT vec_id, label, list_transform(e, lambda x: {_round("x * s.scale")}) AS v FROM r, s
)"""
PAIRS_INT = f"{QUANT}, d AS (SELECT a.vec_id AS qid, b.vec_id, b.label, a.label AS actual, CAST({_distance('a.v', 'b.v')} AS BIGINT) AS d FROM q a, q b WHERE a.vec_id % 100 = 0)"
PAIRS_FLOAT = f"{BASE}, d AS (SELECT a.vec_id AS qid, b.vec_id, b.label, {_distance('a.e', 'b.e')} AS d FROM r a, r b WHERE a.vec_id % 100 = 0)"
_TOP = "n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rn FROM d WHERE vec_id <> qid QUALIFY rn <= 5)"
KNN_INT, KNN_FLOAT = f"{PAIRS_INT}, {_TOP}", f"{PAIRS_FLOAT}, {_TOP}"
VOTES = f"{KNN_INT}, votes AS (SELECT qid, any_value(actual) AS actual, CAST(sum(label) AS INTEGER) AS n_fraud, CAST(count(*) AS INTEGER) AS n_neighbours FROM n GROUP BY qid)"

# --- k-means ----------------------------------------------------------------


def _kmeans(rounds: int, base: str = BASE) -> str:
    """a1, c1, a2, c2, ...: assignments and centroids of each round, from c0."""
    out = [f"{base}, c0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cid, e AS c FROM r QUALIFY cid < {K})"]
    for t in range(1, rounds + 1):
        out.append(
            f"""a{t} AS MATERIALIZED (
  SELECT vec_id, cid FROM (SELECT vec_id, cid, {_distance("e", "c")} AS d FROM r, c{t - 1}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) = 1
), m{t} AS (
  SELECT cid, list(x ORDER BY i) AS c FROM (
    SELECT cid, i, CAST(sum(CAST(round(e[i] * 1000000000) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 1000000000::DOUBLE AS x
    FROM (SELECT a.cid, r.e, unnest(range(1, len(r.e) + 1)) AS i FROM a{t} a JOIN r USING (vec_id)) GROUP BY cid, i
  ) GROUP BY cid
), c{t} AS MATERIALIZED (
  SELECT o.cid, coalesce(m.c, o.c) AS c FROM c{t - 1} o LEFT JOIN m{t} m USING (cid)
)"""
        )
    return ",\n".join(out)


def _moves() -> str:
    each = [f"SELECT {t} AS round, round(sum(sqrt({_distance('o.c', 'n.c')})), 6) AS movement FROM c{t - 1} o JOIN c{t} n USING (cid)" for t in range(1, ROUNDS + 1)]
    return f"WITH {_kmeans(ROUNDS)}\n" + "\nUNION ALL ".join(each)


def _index(base: str = BASE, queries: str = "WHERE l.vec_id % 100 = 0") -> str:
    return f"""{_kmeans(ROUNDS, base)}, sc AS (
  SELECT 16383::DOUBLE / greatest((SELECT largest FROM am), (SELECT max(list_max(list_transform(c, lambda x: abs(x)))) FROM c{ROUNDS})) AS scale
), lists AS MATERIALIZED (
  SELECT r.vec_id, a.cid, r.label, list_transform(r.e, lambda x: {_round("x * sc.scale")}) AS v FROM r JOIN a{ROUNDS} a USING (vec_id), sc
), cents AS MATERIALIZED (
  SELECT cid, list_transform(c, lambda x: {_round("x * sc.scale")}) AS v FROM c{ROUNDS}, sc
), probes AS MATERIALIZED (
  SELECT l.vec_id AS qid, l.v AS qv, l.label AS actual, c.cid, CAST(row_number() OVER (PARTITION BY l.vec_id ORDER BY {_distance("l.v", "c.v")}, c.cid) AS INTEGER) AS crank
  FROM lists l, cents c {queries}
), cand AS MATERIALIZED (
  SELECT p.qid, p.actual, p.crank, l.vec_id, l.label, CAST({_distance("p.qv", "l.v")} AS BIGINT) AS d FROM probes p JOIN lists l USING (cid)
)"""


INDEX = _index()
#: The same index over the feature vectors of payloads; errors are labelled 1.
EVENTS = f"""{PAYLOADS}, r AS (
  SELECT event_id AS vec_id, list_transform([{", ".join(f"CAST({f} AS FLOAT)" for f in FEATURES)}], lambda x: CAST(x AS DOUBLE)) AS e, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM p
), am AS (
  SELECT max(list_max(list_transform(e, lambda x: abs(x)))) AS largest FROM r
)"""


def _ivf_top(nprobe: int, skip_self: bool, name: str) -> str:
    own = " AND vec_id <> qid" if skip_self else ""
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, crank, vec_id) AS rn FROM cand WHERE crank <= {nprobe}{own} QUALIFY rn <= 5)"


def _adaptive(index: str = INDEX, fast: int = FAST, full: int = FULL, result: str = "qid, fast_count, full_count, n_fraud, n_fraud < 3 AS approved") -> str:
    count = lambda t: f"SELECT qid, CAST(sum(label) AS INTEGER) AS n FROM {t} GROUP BY qid"
    return f"""WITH {index}, {_ivf_top(fast, False, "fa")}, {_ivf_top(full, False, "fu")}, x AS (
  SELECT b.qid, coalesce(a.n, 0) AS fast_count, b.n AS full_count FROM ({count("fu")}) b LEFT JOIN ({count("fa")}) a USING (qid)
), y AS (SELECT *, CASE WHEN fast_count IN (2, 3) THEN full_count ELSE fast_count END AS n_fraud FROM x)
SELECT {result} FROM y"""


def _sweep() -> str:
    tops = ", ".join(_ivf_top(n, True, f"t{n}") for n in NPROBES)
    each = " UNION ALL ".join(f"SELECT {n} AS nprobe, qid, any_value(actual) AS actual, sum(label) AS n_fraud FROM t{n} GROUP BY qid" for n in NPROBES)
    return f"""WITH {INDEX}, {tops}
SELECT nprobe, count(*) AS n, CAST(sum(n_fraud) AS BIGINT) AS votes, CAST(sum(CASE WHEN (actual = 1) <> (n_fraud >= 3) THEN 1 ELSE 0 END) AS BIGINT) AS wrong FROM ({each}) GROUP BY nprobe"""


def _recall(nprobe: int = FULL) -> str:
    exact = f"ed AS (SELECT a.vec_id AS qid, b.vec_id, {_distance('a.e', 'b.e')} AS d FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), ex AS (SELECT qid, vec_id FROM ed QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) <= 5)"
    return f"""WITH {INDEX}, {_ivf_top(nprobe, True, "t")}, {exact}
SELECT ex.qid, count(t.vec_id) AS n_common, count(t.vec_id) / 5.0::DOUBLE AS recall FROM ex LEFT JOIN t ON t.qid = ex.qid AND t.vec_id = ex.vec_id GROUP BY ex.qid"""


# The six answers.
RESPONSE = """CASE n_fraud WHEN 0 THEN '{"approved":true,"fraud_score":0.0}' WHEN 1 THEN '{"approved":true,"fraud_score":0.2}' WHEN 2 THEN '{"approved":true,"fraud_score":0.4}'
  WHEN 3 THEN '{"approved":false,"fraud_score":0.6}' WHEN 4 THEN '{"approved":false,"fraud_score":0.8}' ELSE '{"approved":false,"fraud_score":1.0}' END"""

ORACLES = {
    "feature_scalars": _feature_sql([0, 1, 2, 7, 8, 13]),
    "feature_calendar": _feature_sql([3, 4]),
    "feature_last_tx": _feature_sql([5, 6]),
    "feature_flags": _feature_sql([9, 10, 11]),
    "feature_mcc_risk": _feature_sql([12]),
    "feature_vector": _vector_sql(),
    "payload_json_roundtrip": _feature_sql([0, 2, 3, 4, 5, 6, 8]),
    "quantize_scale": f"WITH {QUANT} SELECT largest, scale FROM s",
    "quantize_vectors": f"WITH {QUANT} SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, CAST(v[i] AS INTEGER) AS q FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM q)",
    "l2_float_pairs": f"WITH {PAIRS_FLOAT} SELECT qid, vec_id, round(d, 6) AS d FROM d",
    "l2_int_pairs": f"WITH {PAIRS_INT} SELECT qid, vec_id, d FROM d",
    "knn_exact_int": f"WITH {KNN_INT} SELECT qid, vec_id, d, CAST(rn AS INTEGER) AS rn FROM n",
    "knn_exact_float": f"WITH {KNN_FLOAT} SELECT qid, vec_id, CAST(rn AS INTEGER) AS rn FROM n",
    "knn_vote": f"WITH {VOTES} SELECT qid, n_fraud, n_neighbours, n_fraud < 3 AS approved FROM votes",
    "kmeans_init": f"WITH {_kmeans(0)} SELECT cid, CAST(i - 1 AS INTEGER) AS dim, c[i] AS x FROM (SELECT cid, c, unnest(range(1, len(c) + 1)) AS i FROM c0)",
    "kmeans_assign": f"WITH {_kmeans(1)} SELECT vec_id, cid FROM a1",
    "kmeans_update": f"WITH {_kmeans(1)} SELECT cid, CAST(i - 1 AS INTEGER) AS dim, c[i] AS x FROM (SELECT cid, c, unnest(range(1, len(c) + 1)) AS i FROM c1)",
    "kmeans_movement": _moves(),
    "kmeans_t3": f"WITH {_kmeans(ROUNDS)} SELECT vec_id, cid FROM a{ROUNDS}",
    "ivf_list_sizes": f"WITH {INDEX}, z AS (SELECT cents.cid, count(l.vec_id) AS size FROM cents LEFT JOIN lists l USING (cid) GROUP BY cents.cid) SELECT cid, size, CAST(coalesce(sum(size) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM z",
    "ivf_probe": f"WITH {INDEX} SELECT qid, crank, cid FROM probes WHERE crank <= {FULL}",
    "ivf_search": f"WITH {INDEX}, {_ivf_top(FULL, False, 't')} SELECT qid, vec_id, d, CAST(rn AS INTEGER) AS rn FROM t",
    "ivf_adaptive": _adaptive(),
    "nprobe_sweep": _sweep(),
    "ivf_recall": _recall(),
    "confusion_score": f"""WITH {VOTES}, k AS (
  SELECT count(*) AS n, count(*) FILTER (actual = 1 AND n_fraud >= 3) AS tp, count(*) FILTER (actual = 0 AND n_fraud >= 3) AS fp,
    count(*) FILTER (actual = 1 AND n_fraud < 3) AS fn, count(*) FILTER (actual = 0 AND n_fraud < 3) AS tn, CAST(0 AS BIGINT) AS errors FROM votes
), w AS (SELECT *, fp + 3 * fn + 5 * errors AS weighted_errors FROM k)
SELECT *, round(1000 * log10(1 / greatest(CAST(weighted_errors AS DOUBLE) / n, 0.001::DOUBLE)) - 300 * log10(1.0::DOUBLE + weighted_errors), 6) AS detection_score FROM w""",
    "latency_score": """WITH x AS (SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS max_ms FROM events)
SELECT round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, round(max_ms, 6) AS max_ms, round(1000 * log10(1000 / greatest(p99, 1.0::DOUBLE)), 6) AS p99_score FROM x""",
    "latency_histogram": "SELECT CAST((value >= 1)::INT + (value >= 5)::INT + (value >= 10)::INT + (value >= 50)::INT + (value >= 100)::INT AS INTEGER) AS bucket, count(*) AS n FROM events GROUP BY 1",
    "stage_stats": """WITH x AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events)
SELECT event_type, count(*) AS calls, CAST(sum(c) AS BIGINT) AS total, max(c) AS largest, round(CAST(sum(c) AS DOUBLE) / count(*), 6) AS average,
  round(100.0::DOUBLE * CAST(sum(c) AS DOUBLE) / (SELECT CAST(sum(c) AS DOUBLE) FROM x), 6) AS share FROM x GROUP BY event_type""",
    "ivf_stored_search": f"WITH {INDEX}, {_ivf_top(DEEP, True, 't')} SELECT qid, vec_id, d, CAST(rn AS INTEGER) AS rn FROM t",
    "ivf_stored_recall": _recall(DEEP),
    "knn_score": f"""WITH {INDEX}, {_ivf_top(DEEP, False, 't')}, s AS (SELECT qid, CAST(sum(label) AS INTEGER) AS n_fraud FROM t GROUP BY qid)
SELECT qid, n_fraud, n_fraud / 5.0::DOUBLE AS fraud_score, n_fraud < 3 AS approved FROM s""",
    "score_payloads": _adaptive(_index(EVENTS, ""), FAST, DEEP, f"qid, {RESPONSE} AS response"),
    "stream_decisions": _adaptive(_index(EVENTS, ""), FAST, DEEP, f"qid, {RESPONSE} AS response"),
    "respond": f"""WITH {PAYLOADS} SELECT event_id AS qid, CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 400 END AS status,
  CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'not found' ELSE 'bad request' END AS response FROM p""",
    "references_json": f"SELECT vec_id AS ref_id, CASE WHEN label < 3 THEN 1 ELSE 0 END AS label, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "lookup_risk": _feature_sql([12]),
    "decision_json": f"""WITH {VOTES} SELECT qid, {RESPONSE} AS response FROM votes""",
}
