"""The same queries in SQL."""

_TRADE = """trade_rows AS (
  SELECT o_custkey AS src, l_suppkey + 1000000000 AS dst, CAST(1 AS BIGINT) AS weight, l_returnflag AS body, l_linestatus AS link,
         epoch_us(l_shipdate) // 1000 AS date, l_orderkey * 10 + l_linenumber AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), trade AS (
  SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight, arg_min(body, (date, ord)) AS firstItemBody, arg_max(body, (date, ord)) AS lastItemBody,
         arg_min(link, (date, ord)) AS firstItemLink, arg_max(link, (date, ord)) AS lastItemLink, min(date) AS firstItemDate, max(date) AS lastItemDate
  FROM trade_rows GROUP BY src, dst
)"""
_FLOW = """pairs AS (SELECT lag(user_id) OVER w AS src, user_id AS dst FROM events WINDOW w AS (ORDER BY ts, event_id)),
flow AS (SELECT src, dst, count(*) AS weight FROM pairs WHERE src IS NOT NULL GROUP BY src, dst),
users AS (SELECT src AS id FROM flow UNION SELECT dst FROM flow)"""
_GEOGRAPHY = """geography AS (
  SELECT CAST(c_custkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) + 2000000000 AS dst, CAST(1 AS BIGINT) AS weight FROM customer
  UNION ALL SELECT CAST(s_suppkey AS BIGINT) + 1000000000, CAST(s_nationkey AS BIGINT) + 2000000000, 1 FROM supplier
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 2000000000, CAST(n_regionkey AS BIGINT) + 3000000000, 1 FROM nation
), ends AS (SELECT src AS id FROM geography UNION SELECT dst FROM geography)"""
# lengths of the shortest paths between all users, by as many relaxations as the longest of them has edges, and their numbers
_PATHS = """links AS (SELECT src, dst, min(CASE WHEN weight = 0 THEN 1 ELSE weight END) AS w FROM flow WHERE src <> dst GROUP BY src, dst),
relaxed(k, s, v, dist) AS (
  SELECT 0, id, id, CAST(0 AS BIGINT) FROM users WHERE {start}
  UNION ALL
  SELECT k + 1, s, v, min(dist) FROM (SELECT k, s, v, dist FROM relaxed UNION ALL SELECT r.k, r.s, l.dst, r.dist + l.w FROM relaxed r JOIN links l ON l.src = r.v) WHERE k < 24 GROUP BY k, s, v
), d AS (SELECT s, v, dist FROM relaxed WHERE k = 24),
dag AS (SELECT a.s, l.src AS a, l.dst AS b FROM d a JOIN links l ON l.src = a.v JOIN d b ON b.s = a.s AND b.v = l.dst WHERE a.dist + l.w = b.dist),
walked(k, s, v, n) AS (
  SELECT 0, s, s, 1.0::DOUBLE FROM d WHERE s = v
  UNION ALL
  SELECT k + 1, s, b, sum(n) FROM (SELECT w.k, w.s, g.b, w.n FROM walked w JOIN dag g ON g.s = w.s AND g.a = w.v) GROUP BY k, s, b
), sigma AS (SELECT s, v, sum(n) AS n FROM walked GROUP BY s, v),
back(k, s, v, x) AS (
  SELECT 0, s, v, 1.0::DOUBLE FROM sigma
  UNION ALL
  SELECT k + 1, s, a, sum(x) FROM (SELECT t.k, t.s, g.a, t.x * p.n / q.n AS x FROM back t JOIN dag g ON g.s = t.s AND g.b = t.v JOIN sigma p ON p.s = g.s AND p.v = g.a JOIN sigma q ON q.s = g.s AND q.v = g.b) GROUP BY k, s, a
), given AS (SELECT v AS id, sum(x) AS value FROM back WHERE k > 0 AND v <> s GROUP BY v)"""
_ITEMS = """e AS (
  SELECT event_id AS item, user_id AS nick, event_type AS body, 'e' || event_id AS link, epoch_us(ts) // 1000 AS date, lag(user_id) OVER w AS pnick, lag(event_id) OVER w AS parent,
         lag(epoch_us(ts) // 1000) OVER w AS pdate FROM events WINDOW w AS (ORDER BY ts, event_id)
)"""


def _merged(rows: str) -> str:
    """Vertices out of rows (id, name, activity, rating, first, last, url, host, ord, parent)."""
    return f"""
SELECT id, arg_min(name, (p, coalesce(first, 9223372036854775807), ord)) AS nickName, arg_min(activity, (p, coalesce(first, 9223372036854775807), ord)) AS activity,
       arg_min(rating, (p, coalesce(first, 9223372036854775807), ord)) AS rating, min(first) AS firstItemDate, max(last) AS lastItemDate,
       CAST(count(DISTINCT url) FILTER (WHERE NOT p) AS INTEGER) AS urlNumber, CAST(count(DISTINCT host) FILTER (WHERE NOT p) AS INTEGER) AS domainNumber, bool_and(p) AS parentData
FROM ({rows}) GROUP BY id"""


# arg_min skips nulls of its value, so an absent name is spelled out
_OWN = "SELECT nick AS id, 'u' || nick AS name, CAST(1 AS BIGINT) AS activity, nick AS rating, date AS first, date AS last, item % 7 AS url, body AS host, item AS ord, false AS p FROM e"
_PARENT = "SELECT pnick, '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), pdate, pdate, NULL, NULL, item, true FROM e WHERE parent > 0"
_MENTION = "SELECT pnick, 'u' || pnick, CAST(0 AS BIGINT), CAST(0 AS BIGINT), NULL, NULL, NULL, NULL, item, true FROM e WHERE pnick IS NOT NULL"
_REPLY = "SELECT nick + 1, 'u' || (nick + 1), CAST(0 AS BIGINT), CAST(0 AS BIGINT), NULL, NULL, NULL, NULL, item, true FROM e WHERE item % 3 = 0"
_EDGE = """SELECT src, dst, count(*) AS weight, arg_min(body, (date, item)) AS firstItemBody, arg_max(body, (date, item)) AS lastItemBody, arg_min(link, (date, item)) AS firstItemLink,
       arg_max(link, (date, item)) AS lastItemLink, min(date) AS firstItemDate, max(date) AS lastItemDate FROM ({}) GROUP BY src, dst"""
_ANSWERS = "SELECT nick AS src, pnick AS dst, body, link, date, item FROM e WHERE parent > 0"
_EGO_ROWS = f"{_ANSWERS} UNION ALL SELECT nick, pnick, body, link, date, item FROM e WHERE pnick IS NOT NULL UNION ALL SELECT nick, nick + 1, body, link, date, item FROM e WHERE item % 3 = 0"


def _degrees(edges: str) -> str:
    return f"""d AS (
  SELECT id, CAST(sum(i + o) AS BIGINT) AS degree, CAST(sum(i) AS BIGINT) AS inDegree, CAST(sum(o) AS BIGINT) AS outDegree, CAST(sum((i + o) * w) AS BIGINT) AS weightedDegree,
         CAST(sum(i * w) AS BIGINT) AS weightedInDegree, CAST(sum(o * w) AS BIGINT) AS weightedOutDegree
  FROM (SELECT src AS id, 0 AS i, 1 AS o, weight AS w FROM {edges} UNION ALL SELECT dst, 1, 0, weight FROM {edges}) GROUP BY id
)"""


_MEASURED = f"WITH {_TRADE}, {_degrees('trade')}"
_RANKED = f"{_MEASURED}, r AS (SELECT id, weightedDegree AS x, row_number() OVER (ORDER BY weightedDegree, id) - 1 AS rank, count(*) OVER () AS n FROM d)"


def _shares(q: int) -> str:
    return f"SELECT CAST(rank // (n // {q}) AS INTEGER) AS position, x AS value FROM r WHERE n >= {q} AND rank % (n // {q}) = 0 AND rank < (n // {q}) * {q}"


def _eigen(links: str, rounds: int) -> str:
    # the largest sum of a round is only known in the round after, so each step scales what the last one has summed up
    return f"""WITH RECURSIVE {_FLOW}, links AS ({links}), state AS (
  SELECT id, 0 AS k, 0.0::DOUBLE AS u, 1.0::DOUBLE AS h FROM users
  UNION ALL
  SELECT id, k + 1, new, new / max(new) OVER () FROM (
    SELECT s.id, s.k, s.u + coalesce((SELECT sum(t.h) FROM links l JOIN state t ON t.id = l.src WHERE l.dst = s.id), 0) AS new FROM state s WHERE s.k < {rounds}
  )
) SELECT id, round(h, 6) AS eigenCentrality FROM state WHERE k = {rounds}"""


def _pagerank(start: str, tolerance: float) -> str:
    return f"""WITH RECURSIVE {_FLOW}, degree AS (SELECT src, count(*) AS d FROM flow GROUP BY src),
share AS (SELECT flow.src, dst, 1.0::DOUBLE / d AS s FROM flow JOIN degree USING (src)),
state AS (
  SELECT id, 0 AS k, ({start})::DOUBLE AS pr, ({start})::DOUBLE AS delta, true AS going FROM users
  UNION ALL
  SELECT id, k + 1, pr + more, (pr + more) - pr, max((pr + more) - pr) OVER () > {tolerance} FROM (
    SELECT s.id, s.k, s.pr, coalesce((SELECT 0.85 * sum(t.delta * h.s) FROM share h JOIN state t ON t.id = h.src WHERE h.dst = s.id AND t.delta > {tolerance}), 0) AS more
    FROM state s WHERE s.k < 100 AND s.going
  )
) SELECT id, round(arg_max(pr, k), 6) AS pageRank FROM state GROUP BY id"""


_COMPONENTS = f"""WITH RECURSIVE {_GEOGRAPHY}, both_ways AS (SELECT src AS a, dst AS b FROM geography UNION SELECT dst, src FROM geography),
reach(id, seen) AS (SELECT id, id FROM ends UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON w.a = r.seen),
comp AS (SELECT id, min(seen) AS component FROM reach GROUP BY id)"""
_ALL_PATHS = f"WITH RECURSIVE {_FLOW}, {_PATHS.format(start='true')}, all_values AS (SELECT u.id, round(coalesce(value, 0), 6) AS betweennessCentrality FROM users u LEFT JOIN given USING (id))"

_STORED = f"""WITH RECURSIVE {_ITEMS}, ego AS ({_EDGE.format(_EGO_ROWS)}), {_degrees('ego')},
both_ways AS (SELECT src AS a, dst AS b FROM ego UNION SELECT dst, src FROM ego), reach(id, seen) AS (SELECT id, id FROM d UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON w.a = r.seen),
comp AS (SELECT id, min(seen) AS component FROM reach GROUP BY id),
v AS (SELECT id, nullif(nickName, '') AS nickName, activity, rating, firstItemDate, lastItemDate, urlNumber, domainNumber, degree, inDegree, outDegree, coalesce(component, id) AS component
      FROM ({_merged(' UNION ALL '.join((_OWN, _PARENT, _MENTION, _REPLY)))}) LEFT JOIN d USING (id) LEFT JOIN comp USING (id))"""

QUERIES: dict[str, str] = {
    "build_edges_merge": f"WITH {_TRADE} SELECT * FROM trade",
    "vertex_aggregate": f"WITH {_ITEMS} SELECT id, nullif(nickName, '') AS nickName, activity, rating, firstItemDate, lastItemDate, urlNumber, domainNumber, parentData FROM ({_merged(_OWN + ' UNION ALL ' + _PARENT)})",
    "author_network_edges": f"WITH {_ITEMS} {_EDGE.format(_ANSWERS)}",
    "ego_vertices": f"WITH {_ITEMS} SELECT id, id AS nickId, nullif(nickName, '') AS nickName, activity, rating, firstItemDate, lastItemDate, urlNumber, domainNumber, parentData FROM ({_merged(' UNION ALL '.join((_OWN, _PARENT, _MENTION, _REPLY)))})",
    "ego_edges": f"WITH {_ITEMS} {_EDGE.format(_EGO_ROWS)}",
    "ego_expand": f"""WITH {_ITEMS}, seeds AS (SELECT * FROM e WHERE nick = 3 OR pnick = 3),
people AS (SELECT id FROM (SELECT nick AS id, date FROM seeds UNION ALL SELECT pnick, pdate FROM seeds WHERE parent > 0) GROUP BY id ORDER BY max(date) DESC, id LIMIT 5)
SELECT item AS item_id, nick AS nick_id, pnick AS item_parentNickId FROM e WHERE nick = 3 OR pnick = 3 OR nick IN (SELECT id FROM people) OR pnick IN (SELECT id FROM people)""",
    "drop_isolated": f"WITH {_TRADE} SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT src FROM trade)",
    "dangling_ends": f"WITH {_TRADE} SELECT DISTINCT dst AS id FROM trade WHERE dst NOT IN (SELECT c_custkey FROM customer)",
    "partitioned_edges": f"WITH {_FLOW} SELECT s AS strategy, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight, true AS together FROM flow, (VALUES ('CanonicalRandomVertexCut'), ('RandomVertexCut'), ('EdgePartition1D'), ('EdgePartition2D')) v(s) GROUP BY s",
    "triplets": f"WITH {_FLOW} SELECT src, dst, weight * 2 AS weight, src % 2 AS src_parity, dst % 2 AS dst_parity FROM flow",
    "degrees": f"WITH {_FLOW}, {_degrees('flow')} SELECT id, degree, inDegree, outDegree FROM d",
    "degree_only": f"WITH {_FLOW}, {_degrees('flow')} SELECT id, degree FROM d",
    "weighted_degree": f"{_MEASURED} SELECT id, degree, weightedDegree FROM d",
    "weighted_degrees": f"{_MEASURED} SELECT * FROM d",
    "metric_filter_subgraph": f"{_MEASURED}, k AS (SELECT id FROM d WHERE degree >= 5) SELECT src, dst, weight FROM trade WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)",
    "filter_chain": f"{_MEASURED} SELECT * FROM d WHERE degree BETWEEN 2 AND 1000 AND weightedInDegree <= 40",
    "top_vertices": f"{_MEASURED} SELECT * FROM d ORDER BY weightedDegree DESC, id LIMIT 25",
    "summary_stats": f"{_MEASURED} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count({m}) AS count, round(avg({m}), 6) AS mean, CAST(max({m}) AS DOUBLE) AS max, CAST(min({m}) AS DOUBLE) AS min, round(var_samp({m}), 6) AS variance, count_if({m} <> 0)::BIGINT AS non_zeros FROM d"
        for m in ("degree", "weightedDegree", "inDegree")
    ),
    "sign_buckets": f"{_MEASURED} SELECT s AS sign, count(id) AS n FROM (VALUES (-1), (0), (1)) v(s) LEFT JOIN d ON sign(weightedInDegree - weightedOutDegree - 15) = s GROUP BY s",
    "quantiles": f"{_RANKED} {_shares(4)}",
    "percentile_fences": f"{_RANKED}, s AS ({_shares(100)}), q AS (SELECT max(value) FILTER (WHERE position = 25) AS q1, max(value) FILTER (WHERE position = 75) AS q3 FROM s) SELECT coalesce(CAST(q1 - 3 * abs(q3 - q1) AS DOUBLE), 0.0) AS low, coalesce(CAST(q3 + 3 * abs(q3 - q1) AS DOUBLE), 0.0) AS high FROM q",
    "histogram": f"{_MEASURED}, h AS (SELECT CASE WHEN degree = 60 THEN 20 ELSE degree * 20 // 60 + 1 END AS bin, count(*) AS n FROM d WHERE degree BETWEEN 0 AND 60 GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, round((b - 1) * 3.0::DOUBLE, 6) AS start, coalesce(n, 0) AS n FROM range(1, 21) t(b) LEFT JOIN h ON h.bin = b",
    "global_rank": f"{_RANKED} SELECT id, rank FROM r",
    "sampled_scan": "SELECT CAST(least(20, count(*)) AS BIGINT) AS n, CAST(least(20, count(*)) AS BIGINT) AS different, CAST(least(20, count(*)) AS BIGINT) AS known FROM events",
    "union_distinct": f"WITH {_FLOW} SELECT id FROM users",
    "dedup_first": "SELECT event_id AS item_id, user_id AS nick_id FROM events",
    "scalar_functions": """SELECT event_id, '&lt;a b=&quot;' || event_type || '&quot;&gt;&amp;' AS xml, strftime(ts, '%d/%m/%Y %H:%M') AS day, epoch_ms(date_trunc('minute', ts)) AS back,
event_type AS head, 'x' AS tail, CAST(0 AS BIGINT) AS "none" FROM events""",
    "eigen_centrality": _eigen("SELECT src, dst FROM flow", 100),
    "eigen_centrality_undirected": _eigen("SELECT src, dst FROM flow UNION ALL SELECT dst, src FROM flow", 100),
    "pagerank": _pagerank("0.15", 0.01),
    "personalized_pagerank": _pagerank("CASE WHEN id = 1 THEN 1.0 ELSE 0.0 END", 0.0001),
    "connected_components": f"{_COMPONENTS} SELECT id, component FROM comp",
    "giant_component": f"{_COMPONENTS}, big AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT src, dst, weight FROM geography WHERE src IN (SELECT id FROM comp WHERE component IN (SELECT component FROM big))",
    "top_clusters": f"{_COMPONENTS} SELECT component AS cluster, count(*) AS n FROM comp GROUP BY 1 ORDER BY n DESC, cluster LIMIT 10",
    "pregel_hops": f"WITH RECURSIVE {_FLOW}, walk(id, hops) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT f.dst, w.hops + 1 FROM walk w JOIN flow f ON f.src = w.id WHERE w.hops < 20) SELECT u.id, coalesce(min(hops), 1000000) AS hops FROM users u LEFT JOIN walk USING (id) GROUP BY u.id",
    "modularity_score": f"""{_COMPONENTS}, e AS (SELECT weight, a.component AS ca, b.component AS cb FROM geography JOIN comp a ON a.id = src JOIN comp b ON b.id = dst),
k AS (SELECT c, sum(w) AS k FROM (SELECT ca AS c, weight AS w FROM e UNION ALL SELECT cb, weight FROM e) GROUP BY c), i AS (SELECT ca AS c, sum(weight) AS i FROM e WHERE ca = cb GROUP BY ca)
SELECT round(sum(2.0::DOUBLE * coalesce(i, 0) / m - (k / m) ** 2), 6) AS q FROM k LEFT JOIN i USING (c), (SELECT sum(k)::DOUBLE AS m FROM k)""",
    "betweenness": f"{_ALL_PATHS} SELECT * FROM all_values",
    "high_betweenness_set": f"{_ALL_PATHS} SELECT * FROM all_values ORDER BY betweennessCentrality DESC, id LIMIT 20",
    "betweenness_of_pivot": f"WITH RECURSIVE {_FLOW}, {_PATHS.format(start='id = (SELECT min(id) FROM users)')} SELECT id, round(value, 6) AS value FROM given WHERE round(value, 6) > 0",
    "gexf_roundtrip": f"{_STORED} SELECT id, nickName, urlNumber, domainNumber, degree, inDegree, outDegree, component FROM v",
    # an edge of one item has the same text and link first and last
    "gexf_roundtrip_edges": f"WITH {_ITEMS} SELECT src, dst, weight, firstItemBody, CASE WHEN weight > 1 THEN lastItemBody ELSE firstItemBody END AS lastItemBody, firstItemLink, CASE WHEN weight > 1 THEN lastItemLink ELSE firstItemLink END AS lastItemLink FROM ({_EDGE.format(_EGO_ROWS)})",
    "jsonl_roundtrip": f"WITH {_ITEMS} SELECT * FROM ({_EDGE.format(_EGO_ROWS)})",
    "jsonl_roundtrip_vertices": f"{_STORED} SELECT id, nickName, activity, rating, firstItemDate, lastItemDate, urlNumber, domainNumber, degree, component FROM v WHERE nickName IS NOT NULL AND firstItemDate IS NOT NULL",
    "csv_export": f"WITH {_ITEMS} SELECT src, dst, 'Directed' AS type, weight, lastItemBody AS label, CAST(1 AS BIGINT) AS ids FROM ({_EDGE.format(_EGO_ROWS)})",
    "csv_export_nodes": f"{_STORED} SELECT id, nickName AS label, activity, degree, inDegree, outDegree, component FROM v",
    "job_statistics": f"{_MEASURED} SELECT 'vertices' AS name, CAST(count(*) AS DOUBLE) AS value FROM d UNION ALL SELECT 'edges', CAST(count(*) AS DOUBLE) FROM trade "
    + " ".join(
        f"UNION ALL SELECT '{m} {n}', CAST(round({x}, 6) AS DOUBLE) FROM d"
        for m in ("degree", "inDegree", "outDegree", "weightedDegree", "weightedInDegree", "weightedOutDegree")
        for n, x in (("count", f"count({m})"), ("mean", f"avg({m})"), ("max", f"max({m})"), ("min", f"min({m})"), ("variance", f"var_samp({m})"), ("non_zeros", f"count_if({m} <> 0)"))
    ),
}
