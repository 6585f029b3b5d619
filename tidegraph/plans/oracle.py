"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from tidegraph.operators.features import DAILY_FEATURES

RAW = """raw AS (SELECT o_custkey AS src, l_suppkey AS dst, epoch(l_shipdate)::BIGINT AS ts, round(l_extendedprice * 100)::BIGINT AS sat, l_extendedprice AS usd
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""
PAY = RAW + """, pay AS (SELECT src, dst, ts, sat, sat / 1e8 AS btc, usd FROM raw WHERE src <> 0 AND dst <> 0 AND src <> dst)"""
SEQ = PAY + """, seq AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, src, dst, usd, sat) - 1 AS edge_seq FROM pay)"""
SPLIT = SEQ + """, n AS (SELECT count(*) AS n FROM seq), split AS MATERIALIZED (SELECT seq.*, CASE WHEN edge_seq < floor(n * 0.7::DOUBLE) THEN 'train' WHEN edge_seq < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM seq, n)"""
DAILY = PAY + """, daily AS (SELECT *, make_timestamp(ts * 1000000)::DATE AS date FROM pay)"""
IDS = RAW + """, map AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS node_index FROM (SELECT src AS id FROM raw UNION SELECT dst FROM raw) WHERE id <> 0)"""


def between(a: str, b: str) -> str:
    return f"ts BETWEEN epoch(DATE '{a}')::BIGINT AND epoch(DATE '{b}' + INTERVAL 1 DAY)::BIGINT - 1"


def node_features(edges: str = "pay") -> str:
    """CTEs for the 15 features, ending in nf."""
    return f"""
  e AS (SELECT src AS node, dst AS other, 1 AS o, ts, sat FROM {edges} UNION ALL SELECT dst, src, 0, ts, sat FROM {edges}),
  p AS (SELECT node, other, o, count(*) AS n, sum(sat)::BIGINT AS sat FROM e GROUP BY ALL),
  d AS (SELECT node, coalesce(sum(n) FILTER (o = 1), 0)::BIGINT AS dout, coalesce(sum(n) FILTER (o = 0), 0)::BIGINT AS din,
    count(*) FILTER (o = 1) AS uout, count(*) FILTER (o = 0) AS uin, coalesce(sum(sat) FILTER (o = 1), 0)::BIGINT AS sout, coalesce(sum(sat) FILTER (o = 0), 0)::BIGINT AS sin_,
    sum(n * ln(n)) FILTER (o = 1) AS nlout, sum(n * ln(n)) FILTER (o = 0) AS nlin FROM p GROUP BY node),
  g AS (SELECT node, ts, ts - lag(ts) OVER (PARTITION BY node ORDER BY ts) AS gap FROM e),
  t AS (SELECT node, min(ts) AS t0, max(ts) AS t1, count(*) AS n, count(gap) AS ng, avg(gap) AS mu, stddev_samp(gap) AS sd FROM g GROUP BY node),
  r AS (SELECT min(ts) AS a, max(ts) AS b FROM {edges}),
  nf AS (SELECT d.node AS node_idx, round(ln(1 + din), 6) AS log_in_degree, round(ln(1 + dout), 6) AS log_out_degree, round(dout / (din + dout), 6) AS in_out_ratio,
    round(ln(1 + uin), 6) AS log_unique_in, round(ln(1 + uout), 6) AS log_unique_out, round(ln(1 + sin_ / 1e8), 6) AS log_total_btc_in, round(ln(1 + sout / 1e8), 6) AS log_total_btc_out,
    round(CASE WHEN din > 0 THEN ln(1 + sin_ / 1e8 / din) ELSE 0 END, 6) AS log_avg_btc_in, round(CASE WHEN dout > 0 THEN ln(1 + sout / 1e8 / dout) ELSE 0 END, 6) AS log_avg_btc_out,
    round(CASE WHEN b > a THEN (b - t1) / (b - a) ELSE 0 END, 6) AS recency, round(CASE WHEN b > a THEN (t1 - t0) / (b - a) ELSE 0 END, 6) AS activity_span,
    round(CASE WHEN t1 > t0 THEN ln(1 + n / (t1 - t0)) ELSE 0 END, 6) AS log_event_rate, round(CASE WHEN ng >= 2 THEN (sd - mu) / (sd + mu + 1e-8) ELSE 0 END, 6) AS burstiness,
    round(CASE WHEN uout > 1 THEN greatest(0, (ln(dout) - nlout / dout) / ln(uout)) ELSE 0 END, 6) AS out_entropy, round(CASE WHEN uin > 1 THEN greatest(0, (ln(din) - nlin / din) / ln(uin)) ELSE 0 END, 6) AS in_entropy
    FROM d JOIN t USING (node), r)"""


def pair_ctes(asked: str, train: str) -> str:
    """Undirected and directed adjacency and the four scores of asked (a, b), ending in sc."""
    return f"""
  adj AS (SELECT src AS u, dst AS v FROM {train} WHERE src <> dst UNION SELECT dst, src FROM {train} WHERE src <> dst),
  deg AS (SELECT u, count(*) AS d FROM adj GROUP BY u),
  com AS (SELECT q.a, q.b, count(*) AS cn, sum(CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END) AS aa FROM (SELECT DISTINCT a, b FROM {asked}) q
    JOIN adj x ON x.u = q.a JOIN adj y ON y.u = q.b AND y.v = x.v JOIN deg ON deg.u = x.v GROUP BY ALL),
  sc AS (SELECT q.*, coalesce(cn, 0) AS cn, round(coalesce(aa, 0), 6) AS aa, round(CASE WHEN coalesce(da.d, 0) + coalesce(db.d, 0) - coalesce(cn, 0) > 0
    THEN coalesce(cn, 0) / (coalesce(da.d, 0) + coalesce(db.d, 0) - coalesce(cn, 0)) ELSE 0 END, 6) AS jaccard, coalesce(da.d, 0) * coalesce(db.d, 0) AS pa
    FROM {asked} q LEFT JOIN com USING (a, b) LEFT JOIN deg da ON da.u = q.a LEFT JOIN deg db ON db.u = q.b)"""


DIRECTED = """
  dadj AS (SELECT DISTINCT src AS u, dst AS v FROM train), ddeg AS (SELECT u, count(*) AS d FROM dadj GROUP BY u),
  dcom AS (SELECT q.a, q.b, count(*) AS cn, sum(CASE WHEN coalesce(d, 0) > 1 THEN 1 / ln(d) ELSE 0 END) AS aa FROM asked q
    JOIN dadj x ON x.u = q.a JOIN dadj y ON y.u = q.b AND y.v = x.v LEFT JOIN ddeg ON ddeg.u = x.v GROUP BY ALL)"""
ASKED = SPLIT + """, train AS (SELECT * FROM split WHERE split = 'train'), asked AS (SELECT DISTINCT src AS a, dst AS b FROM split WHERE split = 'test')"""


def negative_ctes(n: int, n_hist: int, seed: str, exclude: bool, spare: int = 3, stride: str | None = None) -> str:
    """From q (src, dst), hist (src, dst), pos (src, dst), nodes (node): hs and rn. stride: SQL of the width of a group of ids."""
    group = lambda c: f"{c} - {c} % {stride}" if stride else "0"
    drop = lambda t: f"AND NOT EXISTS (SELECT 1 FROM pos WHERE pos.src = {t}.src AND pos.dst = {t}.cand)" if exclude else ""
    return f"""
  hp AS MATERIALIZED (SELECT q.src, q.dst, h.dst AS cand FROM q JOIN (SELECT DISTINCT src, dst FROM hist) h ON h.src = q.src WHERE h.dst <> q.src AND h.dst <> q.dst),
  hs AS MATERIALIZED (SELECT src, dst, cand FROM hp WHERE true {drop('hp')} QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY md5(concat_ws('|', '{seed}h', src, dst, cand)), cand) <= {n_hist}),
  lack AS MATERIALIZED (SELECT q.src, q.dst, {n} - count(cand) AS need FROM q LEFT JOIN hs ON hs.src = q.src AND hs.dst = q.dst GROUP BY q.src, q.dst),
  ord AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS pos FROM nodes), m AS (SELECT {group('node')} AS g, min(pos) AS f, count(*) AS m FROM ord GROUP BY ALL),
  tr AS (SELECT src, dst, need, k, ('0x' || substr(md5(concat_ws('|', '{seed}r', src, dst, k)), 1, 15))::BIGINT % m + f AS pos FROM lack JOIN m ON g = {group('src')}, range(0, {n * spare}) t(k)),
  dr AS MATERIALIZED (SELECT src, dst, need, node AS cand, min(k) AS k FROM tr JOIN ord USING (pos) GROUP BY ALL),
  rd AS MATERIALIZED (SELECT src, dst, cand, need, k FROM dr WHERE cand <> src AND cand <> dst AND NOT EXISTS (SELECT 1 FROM hs WHERE hs.src = dr.src AND hs.dst = dr.dst AND hs.cand = dr.cand) {drop('dr')}
    QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY k) <= need),
  sh AS MATERIALIZED (SELECT l.src, l.dst, l.need - count(cand) AS short FROM lack l LEFT JOIN rd ON rd.src = l.src AND rd.dst = l.dst GROUP BY l.src, l.dst, l.need HAVING l.need - count(cand) > 0),
  st AS (SELECT src, dst, short, m, f, ('0x' || substr(md5(concat_ws('|', '{seed}w', src, dst)), 1, 15))::BIGINT % m AS b FROM sh JOIN m ON g = {group('src')}),
  rs AS MATERIALIZED (SELECT src, dst, node AS cand, short, (pos - f - b + m) % m AS j FROM st JOIN ord ON pos BETWEEN f AND f + m - 1 WHERE node <> src AND node <> dst),
  rw AS MATERIALIZED (SELECT src, dst, cand FROM rs WHERE NOT EXISTS (SELECT 1 FROM hs WHERE hs.src = rs.src AND hs.dst = rs.dst AND hs.cand = rs.cand)
    AND NOT EXISTS (SELECT 1 FROM rd WHERE rd.src = rs.src AND rd.dst = rs.dst AND rd.cand = rs.cand) {drop('rs')}
    QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY j) <= short),
  ng AS (SELECT src, dst, cand, 'hist' AS kind FROM hs UNION ALL SELECT src, dst, cand, 'random' FROM rd UNION ALL SELECT src, dst, cand, 'random' FROM rw)"""


TRAIN_NODES = "nodes AS (SELECT src AS node FROM train UNION SELECT dst FROM train)"
EVAL = (
    SPLIT
    + f""", train AS (SELECT * FROM split WHERE split = 'train'), {TRAIN_NODES},
  pos AS (SELECT DISTINCT src, dst FROM split WHERE split = 'test' AND src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes)),
  q AS (SELECT src, dst FROM pos ORDER BY md5(concat_ws('|', 'e', src, dst)), src, dst LIMIT 50000), hist AS (SELECT DISTINCT src, dst FROM train),"""
    + negative_ctes(20, 10, "e", True)
    + ", cands AS (SELECT src, dst, cand, 0 AS is_true FROM ng UNION ALL SELECT src, dst, dst, 1 FROM q)"
)
SCORED = EVAL + ", asked AS (SELECT src AS a, cand AS b, dst, is_true FROM cands)," + pair_ctes("asked", "train")


def ranks(score: str, half: str) -> str:
    return SCORED + f""", tr2 AS (SELECT a, dst, max({score}) AS t FROM sc WHERE is_true = 1 GROUP BY ALL)
  SELECT sc.a AS src, sc.dst, 1.0::DOUBLE + count(*) FILTER (is_true = 0 AND {score} > t) + {half} * count(*) FILTER (is_true = 0 AND {score} = t) AS rank
  FROM sc JOIN tr2 ON tr2.a = sc.a AND tr2.dst = sc.dst GROUP BY ALL"""


def pagerank(rounds: int) -> str:
    sql = PAY + """, w AS (SELECT src AS u, dst AS v, count(*) AS w FROM pay GROUP BY ALL), o AS (SELECT u, sum(w) AS t FROM w GROUP BY u),
  l AS (SELECT w.u, v, w.w / t AS p FROM w JOIN o USING (u)), nd AS (SELECT u AS node FROM l UNION SELECT v FROM l),
  nn AS (SELECT node, node NOT IN (SELECT u FROM o) AS dangling, (SELECT count(*) FROM nd) AS n FROM nd), r0 AS MATERIALIZED (SELECT node, dangling, n, 1.0::DOUBLE / n AS rank FROM nn)"""
    for k in range(rounds):
        sql += f""", r{k + 1} AS MATERIALIZED (SELECT r.node, r.dangling, r.n, 0.15 / r.n + 0.85 * (SELECT coalesce(sum(rank) FILTER (dangling), 0) FROM r{k}) / r.n + 0.85 * coalesce(c.c, 0) AS rank
    FROM r{k} r LEFT JOIN (SELECT v, sum(p * rank) AS c FROM l JOIN r{k} s ON s.node = l.u GROUP BY v) c ON c.v = r.node)"""
    return f"WITH {sql} SELECT node, round(rank / (SELECT sum(rank) FROM r{rounds}), 8) AS rank FROM r{rounds}"


def cores(adjacency: str, rounds: int) -> str:
    """CTEs from adjacency (u, v), ending in core (u, c): rounds of h-indexes, more than the tables need to settle."""
    sql = f"h0 AS MATERIALIZED (SELECT u, count(*) AS c FROM {adjacency} GROUP BY u)"
    for k in range(rounds):
        sql += f""", h{k + 1} AS MATERIALIZED (SELECT u, least(any_value(old), max(least(c, r))) AS c FROM
    (SELECT a.u, o.c AS old, n.c, row_number() OVER (PARTITION BY a.u ORDER BY n.c DESC) AS r FROM {adjacency} a JOIN h{k} n ON n.u = a.v JOIN h{k} o ON o.u = a.u) GROUP BY u)"""
    return f"{sql}, core AS (SELECT * FROM h{rounds})"


UNDIRECTED = "a AS MATERIALIZED (SELECT src AS u, dst AS v FROM pay UNION SELECT dst, src FROM pay)"
NUMBERED_DAYS = DAILY + """, days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day_idx FROM (SELECT DISTINCT date FROM daily)), wide AS MATERIALIZED (SELECT max(greatest(src, dst)) + 1 AS w FROM daily),
  dd AS MATERIALIZED (SELECT DISTINCT day_idx, src, dst FROM daily JOIN days USING (date))"""
#: The day graphs as one graph of disjoint parts, and all that topology() finds in it.
TOPOLOGY = NUMBERED_DAYS + f""", a AS MATERIALIZED (SELECT day_idx * w + src AS u, day_idx * w + dst AS v FROM dd, wide UNION SELECT day_idx * w + dst, day_idx * w + src FROM dd, wide),
  l AS MATERIALIZED (SELECT u, v FROM a WHERE u < v), t AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM l x JOIN l y ON y.u = x.v JOIN l z ON z.u = x.u AND z.v = y.v),
  c AS (SELECT u, count(*) AS t FROM (SELECT a AS u FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY u), {cores("a", 15)},
  wc(node, c) USING KEY (node) AS (SELECT u, min(least(u, v)) FROM a GROUP BY u
    UNION SELECT a.v, min(wc.c) FROM wc JOIN a ON a.u = wc.node JOIN recurring.wc AS o ON o.node = a.v WHERE wc.c < o.c GROUP BY a.v),
  dg AS (SELECT u, count(*) AS d FROM a GROUP BY u),
  tp AS MATERIALIZED (SELECT date::VARCHAR AS date, dg.u % w AS node_idx, d AS degree, coalesce(t, 0) AS triangles, CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS clustering, core.c AS core, wc.c % w AS component
    FROM dg JOIN core USING (u) JOIN wc ON wc.node = dg.u LEFT JOIN c ON c.u = dg.u, wide JOIN days ON true WHERE day_idx = dg.u // w)"""
STRONG = """re(date, a, b) AS (SELECT DISTINCT date, src, dst FROM daily UNION SELECT re.date, re.a, e.dst FROM re JOIN daily e ON e.date = re.date AND e.src = re.b),
  sn AS (SELECT DISTINCT date, src AS node FROM daily UNION SELECT date, dst FROM daily),
  sc AS MATERIALIZED (SELECT sn.date::VARCHAR AS date, node, least(node, coalesce(min(x.b), node)) AS component FROM sn LEFT JOIN (SELECT f.date, f.a, f.b FROM re f JOIN re g ON g.date = f.date AND g.a = f.b AND g.b = f.a) x ON x.date = sn.date AND x.a = node GROUP BY sn.date, node)"""
DAY_EVAL = (
    NUMBERED_DAYS
    + """, train AS MATERIALIZED (SELECT DISTINCT (day_idx + k) * w + src AS src, (day_idx + k) * w + dst AS dst FROM dd, wide, range(1, 8) t(k) WHERE day_idx + k >= 7), """
    + "nodes AS (SELECT src AS node FROM train UNION SELECT dst FROM train), hist AS (SELECT * FROM train), "
    + """pos AS MATERIALIZED (SELECT day_idx * w + src AS src, day_idx * w + dst AS dst FROM dd, wide WHERE day_idx * w + src IN (SELECT node FROM nodes) AND day_idx * w + dst IN (SELECT node FROM nodes)),
  q AS (SELECT * FROM pos),"""
    + negative_ctes(20, 10, "d", True, stride="(SELECT w FROM wide)")
    + ", cands AS (SELECT src, dst, cand, 0 AS is_true FROM ng UNION ALL SELECT src, dst, dst, 1 FROM q), asked AS (SELECT src AS a, cand AS b, dst, is_true FROM cands),"
    + pair_ctes("asked", "train")
    + """, lg AS (SELECT a, dst, is_true, h, s FROM (SELECT a, dst, is_true, 'cn' AS h, cn::DOUBLE AS s FROM sc UNION ALL SELECT a, dst, is_true, 'aa', aa FROM sc UNION ALL SELECT a, dst, is_true, 'jaccard', jaccard FROM sc UNION ALL SELECT a, dst, is_true, 'pa', pa FROM sc)),
  tt AS (SELECT a, dst, h, max(s) AS t FROM lg WHERE is_true = 1 GROUP BY ALL), rk AS (SELECT h, lg.a, lg.dst, 1.0::DOUBLE + count(*) FILTER (is_true = 0 AND s > t) AS rank FROM lg JOIN tt USING (a, dst, h) GROUP BY ALL HAVING count(*) > 1),
  hd AS (SELECT date, h AS heuristic, count(*) AS n_queries, round(avg(1 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, median(rank) AS median_rank, round(avg((rank <= 1)::INT), 6) AS hits_1, round(avg((rank <= 3)::INT), 6) AS hits_3,
    round(avg((rank <= 10)::INT), 6) AS hits_10 FROM rk, wide JOIN days ON true WHERE day_idx = a // w GROUP BY date, h)"""
)


def daily_pagerank(rounds: int) -> str:
    sql = DAILY + """, w AS (SELECT date, src AS u, dst AS v, count(*) AS w FROM daily GROUP BY ALL), o AS (SELECT date, u, sum(w) AS t FROM w GROUP BY ALL),
  l AS MATERIALIZED (SELECT date, u, v, w.w / t AS p FROM w JOIN o USING (date, u)), nd AS (SELECT date, u AS node FROM l UNION SELECT date, v FROM l),
  r0 AS MATERIALIZED (SELECT nd.date, node, t IS NULL AS dangling, count(*) OVER (PARTITION BY nd.date) AS n, 1.0::DOUBLE / count(*) OVER (PARTITION BY nd.date) AS rank FROM nd LEFT JOIN o ON o.date = nd.date AND o.u = node)"""
    for k in range(rounds):
        sql += f""", r{k + 1} AS MATERIALIZED (SELECT r.date, r.node, r.dangling, r.n, 0.15 / r.n + 0.85 * coalesce(sum(r.rank) FILTER (r.dangling) OVER (PARTITION BY r.date), 0) / r.n + 0.85 * coalesce(c.c, 0) AS rank
    FROM r{k} r LEFT JOIN (SELECT l.date, v, sum(p * rank) AS c FROM l JOIN r{k} s ON s.date = l.date AND s.node = l.u GROUP BY ALL) c ON c.date = r.date AND c.v = r.node)"""
    return f"WITH {sql} SELECT date::VARCHAR AS date, node AS node_idx, round(rank / sum(rank) OVER (PARTITION BY date), 8) AS rank FROM r{rounds}"


def components() -> str:
    """The smallest node that walks reach, smallest first: a node leaves the search when a smaller one has reached it."""
    return f"""WITH RECURSIVE {PAY}, b AS MATERIALIZED (SELECT src AS u, dst AS v FROM pay UNION SELECT dst, src FROM pay),
  r(node, c) USING KEY (node) AS (SELECT u, min(least(u, v)) FROM b GROUP BY u
    UNION SELECT b.v, min(r.c) FROM r JOIN b ON b.u = r.node JOIN recurring.r AS o ON o.node = b.v WHERE r.c < o.c GROUP BY b.v) SELECT node, c AS component FROM r"""


def _graph_features() -> str:
    return f"""WITH {DAILY}, pr AS (SELECT date, src, dst, count(*) AS n FROM daily GROUP BY ALL),
  dg AS (SELECT date, node, sum(o)::BIGINT AS o, sum(i)::BIGINT AS i, sum(o + i)::BIGINT AS d FROM (SELECT date, src AS node, 1 AS o, 0 AS i FROM daily UNION ALL SELECT date, dst, 0, 1 FROM daily) GROUP BY ALL),
  ds AS (SELECT date, count(*) AS num_nodes, avg(d) AS mean_degree, median(d) AS median_degree, max(d) AS max_degree, stddev_pop(d) AS std_degree FROM dg GROUP BY date),
  sm AS (SELECT date, count(*) AS num_edges, sum(sat)::BIGINT / 1e8 AS total_btc FROM daily GROUP BY date),
  mu AS (SELECT p.date, count(b.src) / count(*) AS reciprocity FROM pr p LEFT JOIN pr b ON b.date = p.date AND b.src = p.dst AND b.dst = p.src GROUP BY p.date),
  xy AS (SELECT d.date, s.o::DOUBLE AS x, t.i::DOUBLE AS y FROM daily d JOIN dg s ON s.date = d.date AND s.node = d.src JOIN dg t ON t.date = d.date AND t.node = d.dst),
  mx AS (SELECT date, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM xy GROUP BY date),
  gi AS (SELECT date, 2 * sum(k * d) / (count(*) * sum(d)) - (count(*) + 1) / count(*) AS gini FROM (SELECT date, d, row_number() OVER (PARTITION BY date ORDER BY d) AS k FROM dg) GROUP BY date)
  SELECT date::VARCHAR AS date, num_edges, num_nodes, total_btc, round(CASE WHEN num_nodes > 1 THEN num_edges / (num_nodes * (num_nodes - 1)) ELSE 0 END, 6) AS density, round(mean_degree, 6) AS mean_degree, round(median_degree, 6) AS median_degree,
  max_degree, round(std_degree, 6) AS std_degree, round(reciprocity, 6) AS reciprocity,
  round(CASE WHEN n > 1 AND n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) ELSE 0 END, 6) AS assortativity, round(gini, 6) AS gini_degree
  FROM sm JOIN ds USING (date) JOIN mu USING (date) JOIN mx USING (date) JOIN gi USING (date)"""


def _daily_nodes() -> str:
    side = lambda o, name: f"""count(*) FILTER (o = {o}) AS {name}_degree, coalesce(sum(sat) FILTER (o = {o}), 0)::BIGINT / 1e8 AS total_btc_{name}, round(coalesce(sum(usd) FILTER (o = {o}), 0), 2) AS total_usd_{name},
  round(coalesce(avg(btc) FILTER (o = {o}), 0), 10) AS mean_btc_{name}, round(coalesce(median(btc) FILTER (o = {o}), 0), 10) AS median_btc_{name}, coalesce(max(btc) FILTER (o = {o}), 0) AS max_btc_{name},
  coalesce(min(btc) FILTER (o = {o}), 0) AS min_btc_{name}, round(coalesce(stddev_samp(btc) FILTER (o = {o}), 0), 6) AS std_btc_{name}, count(DISTINCT other) FILTER (o = {o}) AS unique_{name}"""  # noqa: E731
    return f"""WITH {DAILY}, e AS (SELECT date, src AS node_idx, dst AS other, 1 AS o, btc, usd, sat FROM daily UNION ALL SELECT date, dst, src, 0, btc, usd, sat FROM daily),
  f AS (SELECT date, node_idx, {side(0, 'in')}, {side(1, 'out')} FROM e GROUP BY ALL)
  SELECT * REPLACE (date::VARCHAR AS date), in_degree + out_degree AS total_degree, round(total_btc_in - total_btc_out, 8) AS balance_btc, round(total_usd_in - total_usd_out, 2) AS balance_usd FROM f"""


NODE_DAYS = DAILY + """, dn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day_idx FROM (SELECT DISTINCT date FROM daily)),
  nd AS (SELECT src AS node_idx, day_idx, sum(sat)::DOUBLE AS x FROM daily JOIN dn USING (date) GROUP BY ALL)"""
FEATURES = "log_in_degree log_out_degree in_out_ratio log_unique_in log_unique_out log_total_btc_in log_total_btc_out log_avg_btc_in log_avg_btc_out recency activity_span log_event_rate burstiness out_entropy in_entropy".split()
PAST = """, ev AS (SELECT src AS node, dst AS nbr, ts, edge_seq FROM seq)"""
PARTNERS = SEQ + """, bo AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY node ORDER BY edge_seq) AS r FROM (SELECT src AS node, dst AS p, edge_seq, 's' AS en FROM seq UNION ALL SELECT dst, src, edge_seq, 'd' FROM seq)),
  pa AS MATERIALIZED (SELECT x.edge_seq, x.en, coalesce(list(y.p ORDER BY y.r) FILTER (y.p IS NOT NULL), []) AS l FROM (SELECT edge_seq, en, node, r, unnest(range(r - 4, r)) AS t FROM bo) x LEFT JOIN bo y ON y.node = x.node AND y.r = x.t GROUP BY x.edge_seq, x.en),
  rp AS (SELECT s.edge_seq, s.l AS a, d.l AS b FROM pa s JOIN pa d ON d.edge_seq = s.edge_seq AND d.en = 'd' WHERE s.en = 's')"""


def recent(k: int, queries: str) -> str:
    return f"""nb AS (SELECT q.edge_seq AS query_id, q.ts AS qts, ev.nbr, ev.edge_seq AS seq, ev.ts, row_number() OVER (PARTITION BY q.edge_seq ORDER BY ev.ts DESC, ev.edge_seq DESC) AS r
  FROM {queries} q JOIN ev ON ev.node = q.src AND ev.ts < q.ts QUALIFY r <= {k}), nr AS (SELECT query_id, count(*) OVER (PARTITION BY query_id) - r AS pos, nbr, seq, qts - ts AS age FROM nb)"""


NAIVE = DAILY + """, nn AS (SELECT date, count(DISTINCT x) AS num_nodes FROM (SELECT date, src AS x FROM daily UNION ALL SELECT date, dst FROM daily) GROUP BY date),
  dd AS (SELECT date, count(*)::DOUBLE AS num_edges, any_value(num_nodes)::DOUBLE AS num_nodes, sum(sat)::BIGINT / 1e8 AS total_btc, round(sum(usd), 2) AS total_usd FROM daily JOIN nn USING (date) GROUP BY date),
  tt AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n FROM dd),
  s AS (SELECT 'num_edges' AS target, t, n, num_edges AS y FROM tt UNION ALL SELECT 'num_nodes', t, n, num_nodes FROM tt UNION ALL SELECT 'total_btc', t, n, total_btc FROM tt UNION ALL SELECT 'total_usd', t, n, total_usd FROM tt),
  k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY t DESC) AS back FROM s WHERE t < floor(n * 0.8::DOUBLE)),
  f AS (SELECT target, max(y) FILTER (back = 1) AS p, avg(y) FILTER (back <= 7) AS m7, avg(y) FILTER (back <= 30) AS m30, max(t) AS last FROM k GROUP BY target),
  x AS (SELECT s.target, s.t, s.y, f.* EXCLUDE (target) FROM s JOIN f USING (target) WHERE s.t >= floor(n * 0.8::DOUBLE)),
  o AS (SELECT target, t, y, 'persistence' AS model, p AS forecast FROM x UNION ALL SELECT target, t, y, 'moving_average_7', m7 FROM x UNION ALL SELECT target, t, y, 'moving_average_30', m30 FROM x
  UNION ALL SELECT x.target, x.t, x.y, 'seasonal', k.y FROM x JOIN k ON k.target = x.target AND k.back = 7 - (x.t - last - 1) % 7)"""


def oracle_sql() -> dict[str, str]:
    corr = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM nf" for k, a in enumerate(FEATURES) for b in FEATURES[k + 1 :])
    joint = ", ".join(f"CASE WHEN s.node_idx IS NOT NULL AND d.node_idx IS NOT NULL THEN {{x}}.{c} ELSE 0 END AS {{n}}_{c}" for c in FEATURES)
    mix = lambda op, n: ", ".join(f"round(src_{c} {op} dst_{c}, 6) + 0.0::DOUBLE AS {n}_{c}" for c in FEATURES)
    both = ", ".join(f"coalesce({t}.{c}, 0) AS {n}_{c}" for t, n in (("s", "src"), ("d", "dst")) for c in FEATURES)
    return {
        "stream_report": f"""WITH {PAY}, pr AS (SELECT DISTINCT src, dst FROM pay), nd AS (SELECT count(*) AS n FROM (SELECT src FROM pay UNION SELECT dst FROM pay)),
  od AS (SELECT avg(c) AS a, median(c) AS m, max(c) AS x FROM (SELECT count(*) AS c FROM pr GROUP BY src)), idg AS (SELECT avg(c) AS a, median(c) AS m, max(c) AS x FROM (SELECT count(*) AS c FROM pr GROUP BY dst)), pc AS (SELECT count(*) AS p FROM pr)
  SELECT count(*) AS num_edges, any_value(nd.n) AS num_nodes, count(DISTINCT src) AS unique_sources, count(DISTINCT dst) AS unique_destinations, min(ts) AS timestamp_min, max(ts) AS timestamp_max,
  sum(sat)::BIGINT / 1e8 AS total_btc, round(sum(usd), 2) AS total_usd, sum(sat)::BIGINT / count(*) / 1e8 AS mean_btc, median(sat) / 1e8 AS median_btc, max(sat) / 1e8 AS max_btc,
  any_value(p) AS unique_directed_edges, count(*) - any_value(p) AS repeated_pair_events, count(*) FILTER (src = dst) AS self_loops,
  any_value(od.a) AS mean_out_degree, any_value(od.m) AS median_out_degree, any_value(od.x) AS max_out_degree, any_value(idg.a) AS mean_in_degree, any_value(idg.m) AS median_in_degree, any_value(idg.x) AS max_in_degree,
  any_value(p) / (any_value(nd.n) * (any_value(nd.n) - 1)) AS density_directed FROM pay, nd, od, idg, pc""",
        "raw_profile": f"WITH {RAW} SELECT count(*) AS n_rows, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst, count(*) FILTER (src = 0 OR dst = 0) AS entity_zero, count(*) FILTER (src = dst) AS self_loops, min(sat) AS min_sat, max(sat) AS max_sat, sum(sat)::BIGINT AS sum_sat FROM raw",
        "entity_mapping": f"WITH {IDS} SELECT id AS entity_id, node_index FROM map",
        "mapped_edges": f"WITH {IDS}, pay AS (SELECT * FROM raw WHERE src <> 0 AND dst <> 0 AND src <> dst) SELECT a.node_index AS src_idx, b.node_index AS dst_idx, count(*) AS n, sum(sat)::BIGINT AS sat FROM pay JOIN map a ON a.id = src JOIN map b ON b.id = dst GROUP BY ALL",
        "clean_edges": f"WITH {PAY} SELECT src AS src_idx, dst AS dst_idx, ts AS timestamp, btc, usd FROM pay",
        "edge_positions": f"WITH {SEQ} SELECT edge_seq, ts AS timestamp, src AS src_idx, dst AS dst_idx, sat FROM seq",
        "bipartite_edges": f"WITH {PAY} SELECT src AS src_idx, dst + (SELECT max(src) + 1 FROM pay) AS dst_idx, ts AS timestamp, sat FROM pay",
        "dense_remap": f"WITH {PAY}, map AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT src AS id FROM pay UNION SELECT dst FROM pay)) SELECT a.k AS src_idx, b.k AS dst_idx, count(*) AS n FROM pay JOIN map a ON a.id = src JOIN map b ON b.id = dst GROUP BY ALL",
        "dense_bundle": f"WITH {PAY}, seq AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, src, dst, usd, sat) - 1 AS edge_seq FROM pay), few AS (SELECT * FROM seq WHERE edge_seq < 1000), map AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT src AS id FROM few UNION SELECT dst FROM few)), {node_features()} SELECT edge_seq, a.k AS src_idx, b.k AS dst_idx, {", ".join(FEATURES)} FROM few JOIN map a ON a.id = src JOIN map b ON b.id = dst LEFT JOIN nf ON node_idx = src",
        "date_range_slice": f"WITH {PAY} SELECT src AS src_idx, dst AS dst_idx, ts AS timestamp, sat FROM pay WHERE {between('1996-01-01', '1996-03-31')}",
        "prefix_slice": f"WITH {SEQ} SELECT edge_seq, ts AS timestamp, sat FROM seq WHERE edge_seq < floor((SELECT count(*) FROM seq) * 0.1::DOUBLE)",
        "chrono_split": f"WITH {SPLIT} SELECT split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, sum(sat)::BIGINT AS sat FROM split GROUP BY split",
        "day_windows": f"WITH {DAILY}, dn AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS b FROM (SELECT DISTINCT date FROM daily)) SELECT date::VARCHAR AS date, CASE WHEN b = 0 THEN 'test' WHEN b = 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(sat)::BIGINT AS sat FROM daily JOIN dn USING (date) WHERE b <= 8 GROUP BY ALL",
        "known_edges": f"WITH {SPLIT}, nd AS (SELECT src AS node FROM split WHERE split = 'train' UNION SELECT dst FROM split WHERE split = 'train') SELECT split, count(*) AS n, sum(sat)::BIGINT AS sat FROM split WHERE split <> 'train' AND src IN (SELECT node FROM nd) AND dst IN (SELECT node FROM nd) GROUP BY split",
        "undirected_stream": f"WITH {SEQ}, b AS (SELECT ts, 0 AS dir, edge_seq, src, dst FROM seq UNION ALL SELECT ts, 1, edge_seq, dst, src FROM seq) SELECT row_number() OVER (ORDER BY ts, dir, edge_seq) - 1 AS pos, dir, src AS src_idx, dst AS dst_idx FROM b",
        "daily_stats": f"WITH {DAILY}, nd AS (SELECT date, count(DISTINCT x) AS num_nodes FROM (SELECT date, src AS x FROM daily UNION ALL SELECT date, dst FROM daily) GROUP BY date) SELECT date::VARCHAR AS date, count(*) AS num_edges, count(DISTINCT (src, dst)) AS num_pairs, sum(sat)::BIGINT / 1e8 AS total_btc, round(sum(usd), 2) AS total_usd, any_value(num_nodes) AS num_nodes FROM daily JOIN nd USING (date) GROUP BY daily.date",
        "pair_rollup": f"WITH {PAY} SELECT src AS src_idx, dst AS dst_idx, count(*) AS event_count, sum(sat)::BIGINT / 1e8 AS total_btc, round(sum(usd), 2) AS total_usd, min(ts) AS first_ts, max(ts) AS last_ts FROM pay GROUP BY ALL",
        "neighbor_sets": f"WITH {PAY} SELECT src AS node, count(DISTINCT dst) AS n, string_agg(DISTINCT dst::VARCHAR, ',' ORDER BY dst) AS neighbors FROM (SELECT DISTINCT src, dst FROM pay) GROUP BY src".replace("string_agg(DISTINCT dst", "string_agg(dst"),
        "active_nodes": f"WITH {PAY} SELECT src AS node FROM pay UNION SELECT dst FROM pay",
        "degree_histogram": f"WITH {PAY} SELECT c AS degree, count(*) AS n_nodes FROM (SELECT count(*) AS c FROM pay GROUP BY src) GROUP BY c",
        "hourly_activity": "SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1",
        "tumbling_30m": "SELECT (floor(epoch(ts) / 1800) * 1800)::BIGINT AS window_start, count(*) AS n FROM events GROUP BY 1",
        "value_histogram": f"WITH {PAY}, x AS (SELECT round(log10(btc + 1e-10), 9) AS x FROM pay), r AS (SELECT min(x) AS a, max(x) AS b FROM x) SELECT least(79, floor((x - a) / ((b - a) / 80)))::BIGINT AS bin, count(*) AS n FROM x, r GROUP BY 1",
        "entity_overlap": f"WITH {DAILY}, e AS (SELECT date, src AS node FROM daily UNION ALL SELECT date, dst FROM daily), s AS (SELECT node, max((date = DATE '1996-01-02')::INT) AS a, max((date = DATE '1996-01-03')::INT) AS b FROM e WHERE date IN (DATE '1996-01-02', DATE '1996-01-03') GROUP BY node) SELECT sum(a * b)::BIGINT AS both, sum(a * (1 - b))::BIGINT AS only_first, sum((1 - a) * b)::BIGINT AS only_second FROM s",
        "topk_subgraph": f"WITH {PAY}, t AS (SELECT node FROM (SELECT src AS node FROM pay UNION ALL SELECT dst FROM pay) GROUP BY node ORDER BY count(*) DESC, node LIMIT 30) SELECT src AS src_idx, dst AS dst_idx, count(*) AS event_count FROM pay WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t) GROUP BY ALL",
        "hub_projection": f"WITH {PAY}, h AS (SELECT node AS hub FROM (SELECT src AS node FROM pay UNION ALL SELECT dst FROM pay) GROUP BY node ORDER BY count(*) DESC, node LIMIT 1), p AS (SELECT src, dst, count(*) AS c FROM pay GROUP BY ALL), l AS (SELECT hub, 'out' AS direction, src, dst, c, dst AS other FROM p, h WHERE src = hub UNION ALL SELECT hub, 'in', src, dst, c, src FROM p, h WHERE dst = hub), r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY c DESC, other) > 10 AS later FROM l), k AS (SELECT * FROM r ORDER BY later, c DESC, direction, other LIMIT 39) SELECT hub, direction, src AS src_idx, dst AS dst_idx, c AS event_count FROM k ORDER BY c DESC, src, dst LIMIT 60",
        "value_transforms": "SELECT event_id, round(sign(value) * ln(1 + abs(value)), 6) AS slog, round(ln(1 + greatest(value, 0)), 6) AS log FROM events",
        "time_encodings": "WITH t AS (SELECT event_id, (epoch(ts)::BIGINT % 86400)::DOUBLE AS t FROM events) SELECT event_id, round(cos(t), 6) AS e0, round(cos(t * pow(10.0::DOUBLE, -3.0::DOUBLE)), 6) AS e1, round(cos(t * pow(10.0::DOUBLE, -6.0::DOUBLE)), 6) AS e2, round(cos(t * pow(10.0::DOUBLE, -9.0::DOUBLE)), 6) AS e3 FROM t".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"),
        "node_features_15": f"WITH {PAY}, {node_features()} SELECT * FROM nf",
        "feature_corr": f"WITH {PAY}, {node_features()} {corr}",
        "daily_node_features": _daily_nodes(),
        "daily_graph_features": _graph_features(),
        "window_mean": f"WITH {NODE_DAYS} SELECT node_idx, day_idx, round(avg(x) OVER (PARTITION BY node_idx ORDER BY day_idx RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING), 2) AS mean FROM nd",
        "window_decay": f"WITH {NODE_DAYS} SELECT a.node_idx, a.day_idx, round(sum(exp(-0.1::DOUBLE * (a.day_idx - b.day_idx)) * b.x) / sum(exp(-0.1::DOUBLE * (a.day_idx - b.day_idx))), 2) AS mean FROM nd a LEFT JOIN nd b ON b.node_idx = a.node_idx AND b.day_idx BETWEEN a.day_idx - 30 AND a.day_idx - 1 GROUP BY ALL",
        "triangles": f"""WITH {PAY}, a AS MATERIALIZED (SELECT src AS u, dst AS v FROM pay UNION SELECT dst, src FROM pay), l AS MATERIALIZED (SELECT u, v FROM a WHERE u < v),
  t AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM l x JOIN l y ON y.u = x.v JOIN l z ON z.u = x.u AND z.v = y.v), c AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY node),
  d AS (SELECT u AS node, count(*) AS d FROM a GROUP BY u) SELECT node, d AS degree, coalesce(t, 0) AS triangles, round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6) AS clustering FROM d LEFT JOIN c USING (node)""",
        "pagerank": pagerank(5),
        "weak_components": components(),
        "core_numbers": f"WITH {PAY}, {UNDIRECTED}, {cores('a', 40)} SELECT u AS node, c AS core FROM core",
        "strong_components": f"WITH RECURSIVE {DAILY}, {STRONG} SELECT date, node, component FROM sc",
        "daily_topology": f"WITH RECURSIVE {TOPOLOGY} SELECT date, node_idx, degree, triangles, round(clustering, 6) AS clustering, core, component FROM tp",
        "daily_structure": f"""WITH RECURSIVE {TOPOLOGY}, {STRONG}, ws AS (SELECT date, component, count(*) AS n FROM tp GROUP BY ALL), ss AS (SELECT date, component, count(*) AS n FROM sc GROUP BY ALL)
  SELECT * FROM (SELECT date, sum(triangles)::BIGINT // 3 AS num_triangles, round(avg(clustering), 6) AS mean_clustering, max(core) AS max_core, round(avg(degree), 6) AS avg_neighbor_degree FROM tp GROUP BY date)
  JOIN (SELECT date, count(*) AS num_wcc, max(n) AS largest_wcc, round(max(n) / sum(n), 6) AS wcc_fraction FROM ws GROUP BY date) USING (date)
  JOIN (SELECT date, count(*) AS num_scc, max(n) AS largest_scc, round(max(n) / sum(n), 6) AS scc_fraction FROM ss GROUP BY date) USING (date)""",
        "daily_pagerank": daily_pagerank(5),
        "daily_pagerank_gini": f"SELECT date, round(2 * sum(i * rank) / (count(*) * sum(rank)) - (count(*) + 1) / count(*) + 1e-9, 6) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY rank) AS i FROM ({daily_pagerank(5)})) GROUP BY date",
        "daily_heuristics": f"WITH {DAY_EVAL} SELECT date::VARCHAR AS date, * EXCLUDE date FROM hd",
        "heuristics_over_days": f"WITH {DAY_EVAL} SELECT heuristic, count(*) AS days, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ("mrr", "hits_1", "hits_3", "hits_10")) + " FROM hd GROUP BY heuristic",
        "snapshot_events": f"""WITH {DAILY}, days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day_idx FROM (SELECT DISTINCT date FROM daily)), b AS (SELECT day_idx AS timestamp, 0 AS dir, src AS src_idx, dst AS dst_idx, sat FROM daily JOIN days USING (date)
  UNION ALL SELECT day_idx, 1, dst, src, sat FROM daily JOIN days USING (date)) SELECT row_number() OVER (ORDER BY timestamp, dir, src_idx, dst_idx, sat) - 1 AS pos, * FROM b""",
        "mean_daily_features": f"SELECT node_idx, count(*) AS days, {', '.join(f'round(avg({c}) + 1e-9, 6) AS {c}' for c in DAILY_FEATURES)} FROM ({_daily_nodes()}) GROUP BY node_idx",
        "sliding_window_stream": "SELECT (floor(epoch(ts) / 86400) * 86400)::BIGINT - 86400 * k AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 7) t(k) GROUP BY 1, 2",
        "session_stream": """WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 1800000000, true) AS new FROM events),
  s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
        "pair_scores": f"WITH {ASKED}, {pair_ctes('asked', 'train')} SELECT a, b, cn, aa, jaccard, pa FROM sc",
        "pair_features_7": f"WITH {ASKED}, {pair_ctes('asked', 'train')}, {DIRECTED} SELECT sc.a, sc.b, sc.cn, round(ln(1 + sc.cn), 6) AS log_cn, sc.aa, coalesce(x.cn, 0) AS cn_dir, round(coalesce(x.aa, 0), 6) AS aa_dir, jaccard, round(ln(1 + pa), 6) AS log_pa FROM sc LEFT JOIN dcom x USING (a, b)",
        "pair_features_34": f"WITH {ASKED}, {pair_ctes('asked', 'train')}, {DIRECTED}, {node_features('train')} SELECT sc.a, sc.b, {both}, sc.cn AS cn_undir, sc.aa AS aa_undir, coalesce(x.cn, 0) AS cn_dir, round(coalesce(x.aa, 0), 6) AS aa_dir FROM sc LEFT JOIN dcom x USING (a, b) LEFT JOIN nf s ON s.node_idx = sc.a LEFT JOIN nf d ON d.node_idx = sc.b",
        "pair_features_extended": f"WITH {ASKED}, {node_features('train')}, j AS (SELECT a, b, {joint.format(x='s', n='src')}, {joint.format(x='d', n='dst')} FROM asked LEFT JOIN nf s ON s.node_idx = a LEFT JOIN nf d ON d.node_idx = b) SELECT *, {mix('-', 'diff')}, {mix('*', 'prod')} FROM j",
        "recent_neighbors": f"WITH {SPLIT}{PAST}, tq AS (SELECT * FROM split WHERE split = 'test'), {recent(20, 'tq')} SELECT query_id, pos, nbr, seq, age FROM nr",
        "neighbor_features": f"WITH {SEQ}{PAST}, {recent(3, 'seq')}, {node_features()} SELECT query_id, pos, nbr, age, {", ".join(f"coalesce({c}, 0) AS {c}" for c in FEATURES)}, s.sat FROM nr JOIN seq s ON s.edge_seq = nr.seq LEFT JOIN nf ON nf.node_idx = nbr",
        "recent_partners": f"WITH {PARTNERS} SELECT edge_seq, array_to_string(a, ',') AS src_past, array_to_string(b, ',') AS dst_past FROM rp",
        "neighbor_cooc": f"WITH {PARTNERS} SELECT edge_seq, len(list_intersect(a, b)) AS shared, array_to_string([len([y FOR y IN a IF y = x])::VARCHAR || '/' || len([y FOR y IN b IF y = x])::VARCHAR FOR x IN a], ',') AS counts FROM rp",
        "naive_forecasts": f"WITH {NAIVE} SELECT target, t, y, model, round(forecast, 6) AS forecast FROM o",
        "ts_metrics": f"WITH {NAIVE} SELECT target, model, round(avg(abs(y - forecast)), 6) AS mae, round(sqrt(avg((y - forecast) * (y - forecast))), 6) AS rmse, round(100 * avg(abs((y - forecast) / y)) FILTER (y <> 0), 6) AS mape, round(100 * avg(2 * abs(y - forecast) / (abs(y) + abs(forecast))) FILTER (abs(y) + abs(forecast) <> 0), 6) AS smape FROM o GROUP BY target, model",
        "daily_window_stream": "SELECT (floor(epoch(ts) / 86400) * 86400)::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "partner_state_stream": "WITH e AS (SELECT user_id, event_id, ts, (props->>'$.k')::BIGINT AS p FROM events) SELECT user_id, event_id, coalesce(array_to_string(list(p) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS past FROM e",
        "eval_candidates": f"WITH {EVAL} SELECT * FROM cands",
        "train_negatives": f"WITH {SPLIT}, train AS (SELECT * FROM split WHERE split = 'train'), {TRAIN_NODES}, q AS (SELECT DISTINCT src, dst FROM train), hist AS (SELECT * FROM q), pos AS (SELECT * FROM q), {negative_ctes(5, 2, 't', False)} SELECT * FROM ng",
        "rank_conservative": "WITH " + ranks("jaccard", "0"),
        "rank_mean_tie": "WITH " + ranks("jaccard", "0.5"),
        "heuristic_ranking": "WITH " + SCORED + """, lg AS (SELECT a, dst, is_true, h, s FROM (SELECT a, dst, is_true, 'cn' AS h, cn::DOUBLE AS s FROM sc UNION ALL SELECT a, dst, is_true, 'aa', aa FROM sc UNION ALL SELECT a, dst, is_true, 'jaccard', jaccard FROM sc UNION ALL SELECT a, dst, is_true, 'pa', pa FROM sc)),
  tt AS (SELECT a, dst, h, max(s) AS t FROM lg WHERE is_true = 1 GROUP BY ALL), rk AS (SELECT h, lg.a, lg.dst, 1.0::DOUBLE + count(*) FILTER (is_true = 0 AND s > t) AS rank FROM lg JOIN tt USING (a, dst, h) GROUP BY ALL)
  SELECT h AS heuristic, count(*) AS n_queries, round(avg(1 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, median(rank) AS median_rank, round(avg((rank <= 1)::INT), 6) AS hits_1, round(avg((rank <= 3)::INT), 6) AS hits_3, round(avg((rank <= 10)::INT), 6) AS hits_10 FROM rk GROUP BY h""",
    }
