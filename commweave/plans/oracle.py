"""DuckDB SQL for the named queries, put together from common table expressions."""

from __future__ import annotations

_BOTH = "SELECT src, dst FROM p UNION ALL SELECT dst, src FROM p"
GRAPHS = {
    "copart": "edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey)",
    "part_supp": f"p AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem), edges AS ({_BOTH})",
    "cust_supp": f"p AS (SELECT DISTINCT o_custkey AS src, l_suppkey + 1000000 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), edges AS ({_BOTH})",
    "order_part": f"p AS (SELECT l_orderkey AS src, l_partkey + 1000000 AS dst FROM lineitem), edges AS ({_BOTH})",
    "user_next": "edges AS (SELECT * FROM (SELECT event_id, event_type, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)",
}
_DEG = """verts AS (SELECT src AS v FROM edges UNION SELECT dst FROM edges),
deg AS (SELECT verts.v, CAST(count(e.src) AS BIGINT) AS k FROM verts LEFT JOIN edges e ON e.src = verts.v GROUP BY verts.v)"""
_COMM = "comm AS (SELECT v, k, v % 25 AS c FROM deg)"
_TOT = "tot AS (SELECT c, CAST(sum(k) AS BIGINT) AS t FROM comm GROUP BY c)"


def _with(graph: str, *more: str, comm: str = _COMM) -> str:
    return "WITH RECURSIVE " + ",\n".join([GRAPHS[graph], _DEG, comm, _TOT, *more]) + "\n"


def _moves(where: str = "delta > 1", only: str = "true", edges: str = "edges", deg: str = "deg", weight: str = "count(*)") -> str:
    return f"""two AS (SELECT CAST(sum(k) AS BIGINT) AS two_m FROM {deg}),
w AS (SELECT e.src AS v, n.c AS cand, CAST({weight} AS BIGINT) AS w FROM {edges} e JOIN comm n ON n.v = e.dst WHERE {only} GROUP BY e.src, n.c),
cur AS (SELECT m.v, m.k, m.c, coalesce(w.w, 0) AS w_cur, greatest(t.t - m.k, 0) AS t_cur FROM comm m JOIN tot t ON t.c = m.c LEFT JOIN w ON w.v = m.v AND w.cand = m.c),
sc AS (SELECT cur.v, cur.c AS old_c, w.cand AS new_c, cur.w_cur, w.w AS w_new, (w.w * two.two_m - cur.k * t.t) - (cur.w_cur * two.two_m - cur.k * cur.t_cur) AS delta
  FROM w JOIN cur ON cur.v = w.v JOIN tot t ON t.c = w.cand CROSS JOIN two WHERE w.cand <> cur.c),
rk AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY delta DESC, w_new DESC, new_c) AS rn FROM sc),
moves AS (SELECT v, old_c, new_c, w_cur, w_new, delta FROM rk WHERE rn = 1 AND {where})"""


_APPLIED = "applied AS (SELECT comm.v, comm.k, coalesce(moves.new_c, comm.c) AS c FROM comm LEFT JOIN moves ON moves.v = comm.v)"
_DENSE = "dense AS (SELECT v AS orig, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS v FROM verts)"
_PARTS = f"{_DENSE}, parts AS (SELECT orig AS v, CAST(v // CAST(ceil((SELECT count(*) FROM verts) / 8.0) AS BIGINT) AS BIGINT) AS part FROM dense)"
_SPANS = """sz AS (SELECT c, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS load FROM comm GROUP BY c),
spans AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, load DESC, c) - 1 AS BIGINT) AS rank, c,
  CAST(sum(n) OVER (ORDER BY n DESC, load DESC, c ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS start, n AS length, load AS degree_sum FROM sz)"""
_NEW_IDS = "new_ids AS (SELECT comm.v AS old_v, CAST(row_number() OVER (ORDER BY rank, comm.v) - 1 AS BIGINT) AS new_v, rank FROM comm JOIN spans ON spans.c = comm.c)"
_FIRST = "dc AS (SELECT c, CAST(row_number() OVER (ORDER BY least) - 1 AS BIGINT) AS new_c FROM (SELECT c, min(v) AS least FROM comm GROUP BY c))"
_CONTRACTED = f"""{_FIRST}, vmap AS (SELECT comm.v, dc.new_c FROM comm JOIN dc ON dc.c = comm.c),
half AS (SELECT m.new_c AS a, edges.dst FROM edges JOIN vmap m ON m.v = edges.src),
mapped AS (SELECT half.a, m.new_c AS b FROM half JOIN vmap m ON m.v = half.dst),
pairs AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM mapped WHERE a <> b),
small AS (SELECT a AS src, b AS dst FROM pairs UNION ALL SELECT b, a FROM pairs)"""


def _quality(comm: str) -> str:
    return f"""(SELECT count(*) AS intra, coalesce(CAST(sum(a.k * b.k) AS BIGINT), 0) AS s FROM edges e JOIN {comm} a ON a.v = e.src JOIN {comm} b ON b.v = e.dst WHERE a.c = b.c)"""


_Q = "(CAST(intra AS DOUBLE) - CAST(s AS DOUBLE) / CAST(two_m AS DOUBLE)) / CAST(two_m AS DOUBLE)"
_UPDATES = """upd AS (SELECT event_id AS update_idx, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'INSERT' END AS op, src, dst FROM edges),
res AS (SELECT *, src % 4 AS owner_u, dst % 4 AS owner_v, src % 25 AS c_u, dst % 25 AS c_v, src % 25 % 4 AS c_owner_u, dst % 25 % 4 AS c_owner_v FROM upd)"""


def _step(before: str, turn: str, level: str = "", weight: str = "count(*)") -> str:
    """One step of local moving from the membership ``before`` (v, c), for the vertices of ``turn``."""
    comm = f"comm AS (SELECT b.v, d.k, b.c FROM {before} b JOIN deg{level} d ON d.v = b.v)"
    return f"WITH {comm}, {_TOT}, {_moves(only=turn, edges=f'edges{level}', deg=f'deg{level}', weight=weight)} SELECT comm.v, coalesce(moves.new_c, comm.c) AS c FROM comm LEFT JOIN moves ON moves.v = comm.v"


def _newman(membership: str, level: str = "", weight: str = "count(*)") -> str:
    intra = f"(SELECT coalesce({weight}, 0) AS intra FROM edges{level} e JOIN {membership} a ON a.v = e.src JOIN {membership} b ON b.v = e.dst WHERE a.c = b.c)"
    squares = f"(SELECT CAST(sum(t * t) AS DOUBLE) AS sq, CAST(sum(t) AS DOUBLE) AS m FROM (SELECT CAST(sum(k) AS HUGEINT) AS t FROM {membership} x JOIN deg{level} d ON d.v = x.v GROUP BY x.c))"
    return f"SELECT CAST(intra AS DOUBLE) / m - sq / (m * m) AS q FROM {intra} CROSS JOIN {squares}"


def _rounds(start: str, rounds: int, sub_rounds: int, keep_best: bool = True, among: str = "true", name: str = "m", level: str = "", weight: str = "count(*)") -> tuple[list[str], str]:
    """Tables of rounds of local moving, and the last one's name. A round that lowers modularity is taken back; after that, all are, so that going on changes nothing."""
    parts, now = [], start
    for r in range(rounds):
        first = now
        for g in range(sub_rounds):
            parts.append(f"{name}{r}_{g} AS MATERIALIZED ({_step(now, f'e.src % {sub_rounds} = {g} AND {among}', level, weight)})")
            now = f"{name}{r}_{g}"
        if keep_best:
            parts.append(f"{name}q{r} AS MATERIALIZED (SELECT (SELECT q FROM ({_newman(now, level, weight)})) >= (SELECT q FROM ({_newman(first, level, weight)})) AS better)")
            parts.append(f"{name}{r} AS MATERIALIZED (SELECT v, c FROM {now} WHERE (SELECT better FROM {name}q{r}) UNION ALL SELECT v, c FROM {first} WHERE NOT (SELECT better FROM {name}q{r}))")
            now = f"{name}{r}"
    return parts, now


def _levels(levels: int, rounds: int, sub_rounds: int) -> list[str]:
    """Tables of a whole detection: rounds of each level, its communities as vertices of the next, weights summed up."""
    parts = ["line0 AS (SELECT v AS orig, v AS cur FROM deg)"]
    for i in range(levels):
        level, weight, among = ("", "count(*)", "true") if not i else (f"_{i}", "sum(e.w)", "e.src <> e.dst")
        parts.append(f"alone{i} AS MATERIALIZED (SELECT v, v AS c FROM deg{level})")
        more, end = _rounds(f"alone{i}", rounds, sub_rounds, True, among, f"l{i}_", level, weight)
        parts += more
        parts.append(f"ids{i} AS MATERIALIZED (SELECT c, row_number() OVER (ORDER BY least) - 1 AS new_c FROM (SELECT c, min(v) AS least FROM {end} GROUP BY c))")
        parts.append(f"to{i} AS MATERIALIZED (SELECT x.v, ids{i}.new_c FROM {end} x JOIN ids{i} ON ids{i}.c = x.c)")
        parts.append(f"line{i + 1} AS MATERIALIZED (SELECT x.orig, t.new_c AS cur FROM line{i} x JOIN to{i} t ON t.v = x.cur)")
        w = "count(*)" if not i else "sum(e.w)"
        parts.append(f"edges_{i + 1} AS MATERIALIZED (SELECT a.new_c AS src, b.new_c AS dst, CAST({w} AS BIGINT) AS w FROM edges{level} e JOIN to{i} a ON a.v = e.src JOIN to{i} b ON b.v = e.dst GROUP BY a.new_c, b.new_c)")
        parts.append(f"deg_{i + 1} AS MATERIALIZED (SELECT i.new_c AS v, CAST(coalesce(sum(e.w), 0) AS BIGINT) AS k FROM ids{i} i LEFT JOIN edges_{i + 1} e ON e.src = i.new_c GROUP BY i.new_c)")
    return parts


def _stored(graph: str, *more: str, recursive: bool = False) -> str:
    """A graph's tables computed once, and more tables."""
    once = [x.replace("edges AS (", "edges AS MATERIALIZED (").replace("deg AS (", "deg AS MATERIALIZED (") for x in (GRAPHS[graph], _DEG)]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join([*once, *more]) + "\n"


_ALONE = "alone AS MATERIALIZED (SELECT v, v AS c FROM deg)"
_LOCAL, _LOCAL_END = _rounds("alone", 10, 8)
_AFFECTED, _AFFECTED_END = _rounds("started", 1, 2, keep_best=False, among="e.src IN (SELECT v FROM touched)")
_UPDATED = f"""WITH {GRAPHS['copart'].replace('edges AS', 'base AS')}, {GRAPHS['user_next'].replace('edges AS', 'nexts AS')},
gone AS (SELECT DISTINCT src, dst FROM nexts WHERE event_type = 'error'),
edges AS MATERIALIZED (SELECT base.src, base.dst FROM base ANTI JOIN gone ON gone.src = base.src AND gone.dst = base.dst UNION ALL SELECT src, dst FROM nexts WHERE event_type <> 'error'),
known AS (SELECT src AS v FROM base UNION SELECT dst FROM base),
every AS (SELECT v FROM known UNION SELECT src FROM edges UNION SELECT dst FROM edges),
deg AS MATERIALIZED (SELECT x.v, CAST(count(e.src) AS BIGINT) AS k FROM every x LEFT JOIN edges e ON e.src = x.v GROUP BY x.v),
touched AS MATERIALIZED (SELECT src AS v FROM nexts UNION SELECT dst FROM nexts),
started AS MATERIALIZED (SELECT deg.v, CASE WHEN known.v IS NULL THEN deg.v ELSE deg.v % 25 END AS c FROM deg LEFT JOIN known ON known.v = deg.v),
"""
#: Candidates folded in the order of their first entry.
_STRICT = """two AS (SELECT CAST(sum(k) AS BIGINT) AS two_m FROM deg),
w AS (SELECT e.src AS v, n.c AS cand, count(*) AS w, min(e.event_id) AS pos FROM edges e JOIN comm n ON n.v = e.dst GROUP BY e.src, n.c),
cur AS (SELECT m.v, m.k, m.c, coalesce(w.w, 0) AS w_cur, greatest(t.t - m.k, 0) AS t_cur FROM comm m JOIN tot t ON t.c = m.c LEFT JOIN w ON w.v = m.v AND w.cand = m.c),
sc AS (SELECT cur.v, cur.c, cur.w_cur, w.pos, w.cand, w.w, (w.w * two_m - cur.k * CASE WHEN w.cand = cur.c THEN greatest(t.t - cur.k, 0) ELSE t.t END) - (cur.w_cur * two_m - cur.k * cur.t_cur) AS d
  FROM w JOIN cur ON cur.v = w.v JOIN tot t ON t.c = w.cand CROSS JOIN two),
lists AS (SELECT v, c, w_cur, list({'delta': CAST(d AS BIGINT), 'c': cand, 'w': w} ORDER BY pos) AS seen FROM sc GROUP BY v, c, w_cur),
folded AS (SELECT v, c, w_cur, list_reduce(list_prepend({'delta': CAST(0 AS BIGINT), 'c': c, 'w': w_cur}, seen), lambda a, x:
  CASE WHEN x.delta > a.delta + 1 OR (x.delta > a.delta - 1 AND (x.w > a.w OR x.w = a.w AND x.c < a.c)) THEN x ELSE a END) AS best FROM lists)"""
#: xorshift64* (fixed values), from the state of epoch 1: a draw for the first vertex and two for each update.
_DRAWS = """size AS (SELECT CAST(count(*) AS HUGEINT) AS n, least(1000, count(*), greatest(1, count(*) * 1000 // 10000)) AS rows FROM deg),
draws(i, x) AS (SELECT 0, xor(xor(CAST(11400714819323198485 AS UBIGINT), CAST(1 AS UBIGINT)), CAST(n * 128 AS UBIGINT)) FROM size
  UNION ALL SELECT i + 1, xor(t, t >> 27) FROM (SELECT i, xor(t, (t & CAST(549755813887 AS UBIGINT)) << 25) AS t FROM (SELECT i, xor(x, x >> 12) AS t FROM draws WHERE i < 1 + 2 * (SELECT rows FROM size)))),
drawn AS (SELECT i, CAST(x AS HUGEINT) * 2685821657736338717 % 18446744073709551616 AS x FROM draws WHERE i > 0)"""

ORACLE_SQL = {
    "edge_scan": f"WITH {GRAPHS['user_next']} SELECT src, dst, count(*) AS multiplicity FROM edges GROUP BY src, dst",
    "dense_ids": _with("order_part", _DENSE) + "SELECT orig, v FROM dense",
    "csr_offsets": _with("part_supp") + "SELECT v, k, CAST(sum(k) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - k AS BIGINT) AS start FROM deg",
    "singleton_membership": _with("copart") + "SELECT v, v AS c FROM deg",
    "membership_check": _with(
        "copart",
        _DENSE,
        """num AS (SELECT count(*) AS n FROM verts),
given AS (SELECT CASE WHEN v % 83 = 1 THEN NULL WHEN v % 79 = 2 THEN v + n ELSE v END AS idx, n FROM dense CROSS JOIN num WHERE v % 97 <> 0
  UNION ALL SELECT CASE WHEN v % 83 = 1 THEN NULL WHEN v % 79 = 2 THEN v + n ELSE v END, n FROM dense CROSS JOIN num WHERE v % 97 <> 0 AND v % 89 = 0),
inside AS (SELECT idx, count(*) AS times FROM given WHERE idx < n GROUP BY idx)""",
    )
    + """SELECT 'malformed' AS kind, count(*) AS n FROM given WHERE idx IS NULL UNION ALL SELECT 'out_of_range', count(*) FROM given WHERE idx >= n
UNION ALL SELECT 'duplicate', count(*) FROM inside WHERE times > 1 UNION ALL SELECT 'missing', (SELECT n FROM num) - count(*) FROM inside""",
    "trace_parse": """WITH raw AS (SELECT event_id % 8 AS m, user_id AS u, event_id % 200 AS v, CAST(floor(abs(value)) AS BIGINT) AS w FROM events)
SELECT u AS src, v AS dst, CASE WHEN m IN (2, 7) AND w BETWEEN 1 AND 4294967295 THEN w ELSE 1 END AS weight FROM raw WHERE m IN (2, 3, 4, 6, 7) AND u BETWEEN 0 AND 149 AND v < 150""",
    "degree": _with("user_next") + "SELECT v, k FROM deg",
    "total_degree": " UNION ALL ".join(f"(WITH {GRAPHS[g]} SELECT '{g}' AS graph, count(*) AS two_m FROM edges)" for g in GRAPHS),
    "community_totals": _with("copart") + "SELECT c, t FROM tot",
    "community_sizes": _with("copart") + "SELECT c, count(*) AS n, CAST(sum(k) AS BIGINT) AS load FROM comm GROUP BY c",
    "community_count": _with("copart") + "SELECT count(DISTINCT c) AS n FROM comm",
    "neighbor_communities": _with("user_next") + "SELECT e.src, e.dst, coalesce(m.c, e.dst) AS c FROM edges e LEFT JOIN comm m ON m.v = e.dst",
    "neighbor_weights": _with("order_part") + "SELECT e.src AS v, m.c AS cand, count(*) AS w FROM edges e JOIN comm m ON m.v = e.dst GROUP BY e.src, m.c",
    "sparse_neighbor_map": _with("copart", _PARTS)
    + """SELECT DISTINCT a.part, e.dst AS neighbor, m.c, tot.t FROM edges e JOIN parts a ON a.v = e.src JOIN parts b ON b.v = e.dst JOIN comm m ON m.v = e.dst JOIN tot ON tot.c = m.c
WHERE e.src % 10 = 0 AND a.part <> b.part""",
    "sparse_community_map": _with("copart", _PARTS)
    + """SELECT DISTINCT part, c, t FROM (SELECT a.part, m.c FROM edges e JOIN parts a ON a.v = e.src JOIN parts b ON b.v = e.dst JOIN comm m ON m.v = e.dst WHERE e.src % 10 = 0 AND a.part <> b.part
UNION SELECT a.part, m.c FROM parts a JOIN comm m ON m.v = a.v WHERE a.v % 10 = 0) JOIN tot USING (c)""",
    "adjacency": _with("part_supp", "start AS (SELECT v, CAST(sum(k) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - k AS BIGINT) AS start FROM deg)")
    + "SELECT src AS v, start, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbors FROM edges JOIN start ON start.v = src GROUP BY src, start",
    "membership_by_id": _with("part_supp", _DENSE) + "SELECT dense.v, orig % 25 AS c, (SELECT max(orig % 25) + 1 FROM dense) AS num FROM dense",
    "membership_csv": _with("copart") + "SELECT v, c FROM comm",
    "external_edges": _with("copart", _PARTS) + "SELECT a.part, count(*) AS n_edges FROM edges e JOIN parts a ON a.v = e.src JOIN parts b ON b.v = e.dst WHERE a.part <> b.part GROUP BY a.part",
    "range_partition": _with("copart", _PARTS) + "SELECT v, part FROM parts",
    "community_spans": _with("copart", _SPANS) + "SELECT rank, c, start, length, degree_sum FROM spans",
    "reorder_vertices": _with("copart", _SPANS) + "SELECT comm.v AS old_v, CAST(row_number() OVER (ORDER BY rank, comm.v) - 1 AS BIGINT) AS new_v, rank FROM comm JOIN spans ON spans.c = comm.c",
    "reorder_edges": _with("copart", _SPANS, _NEW_IDS) + "SELECT a.new_v AS src, b.new_v AS dst, a.rank AS src_c, b.rank AS dst_c FROM edges e JOIN new_ids a ON a.old_v = e.src JOIN new_ids b ON b.old_v = e.dst",
    "reorder_graph": _with("copart", _SPANS, _NEW_IDS) + "SELECT new_v AS v, deg.k, rank AS c, old_v FROM new_ids JOIN deg ON deg.v = old_v",
    "pack_communities": _with(
        "copart",
        _SPANS,
        """caps AS (SELECT 3 * max(length) AS nodes, 3 * max(degree_sum) AS entries FROM spans),
walk AS (SELECT rank, CAST(0 AS BIGINT) AS worker, length AS held, degree_sum AS load FROM spans WHERE rank = 0
  UNION ALL SELECT s.rank, CASE WHEN held + s.length > nodes OR load + s.degree_sum > entries THEN worker + 1 ELSE worker END,
    CASE WHEN held + s.length > nodes OR load + s.degree_sum > entries THEN s.length ELSE held + s.length END,
    CASE WHEN held + s.length > nodes OR load + s.degree_sum > entries THEN s.degree_sum ELSE load + s.degree_sum END
  FROM walk JOIN spans s ON s.rank = walk.rank + 1 CROSS JOIN caps)""",
    )
    + "SELECT rank, worker FROM walk",
    "delta_sample": _with("copart")
    + "SELECT v FROM (SELECT v, row_number() OVER (ORDER BY (v * 2654435761 + 7) % 4294967296, v) AS r FROM deg) WHERE r <= greatest(1, (SELECT count(*) FROM deg) * 1000 // 10000)",
    "best_move": _with("copart", _moves()) + "SELECT * FROM moves",
    "best_move_delta": _with("part_supp", _moves(only="e.src % 10 = 3")) + "SELECT * FROM moves",
    "local_move_rounds": _stored("user_next", _ALONE, *_LOCAL) + f"SELECT v, c FROM {_LOCAL_END}",
    "detect_communities": _stored("copart", *_levels(5, 10, 8)) + "SELECT orig AS v, cur AS c FROM line5",
    "incremental_move": _UPDATED + ",\n".join(_AFFECTED) + f" SELECT v, c FROM {_AFFECTED_END}",
    "best_move_directed": _with("user_next", _moves(), comm="comm AS (SELECT v, k, v AS c FROM deg)") + "SELECT * FROM moves",
    "strict_scan_move": _with("user_next", _STRICT)
    + "SELECT v, c AS old_c, best.c AS new_c, w_cur, best.w AS w_new, best.delta AS delta FROM folded WHERE best.c <> c AND best.delta > 1",
    "synth_updates": _stored("user_next", _DRAWS, recursive=True)
    + """SELECT 'INSERT' AS op, CAST(least(u, v) AS BIGINT) AS src, CAST(greatest(u, v) AS BIGINT) AS dst, CAST(weight AS BIGINT) AS weight FROM (
SELECT (f.x % n + r) % n AS u, ((f.x % n + r) % n + a.x % (n - 1) + 1) % n AS v, 1 + b.x % 8 AS weight FROM size, (SELECT unnest(range(1000)) AS r) JOIN drawn f ON f.i = 1 JOIN drawn a ON a.i = 2 + 2 * r JOIN drawn b ON b.i = 3 + 2 * r WHERE r < rows)""",
    "refine_move": _with("part_supp", _moves("w_cur = 0 AND delta >= 0")) + "SELECT * FROM moves",
    "apply_moves": _with("copart", _moves(), _APPLIED) + "SELECT v, c FROM applied",
    "merged_totals": _with("copart", _moves())
    + """SELECT d.c, CAST(greatest(0, coalesce(tot.t, 0) + d.d) AS BIGINT) AS t FROM (SELECT c, sum(d) AS d FROM (SELECT old_c AS c, -k AS d FROM moves JOIN deg ON deg.v = moves.v
UNION ALL SELECT new_c, k FROM moves JOIN deg ON deg.v = moves.v) GROUP BY c HAVING sum(d) <> 0) d LEFT JOIN tot ON tot.c = d.c""",
    "move_count": _with("copart", _moves()) + "SELECT count(*) AS n_moves FROM moves",
    "modularity_edge": _with("copart", "two AS (SELECT CAST(sum(k) AS BIGINT) AS two_m FROM deg)") + f"SELECT intra, s, two_m, {_Q} AS q FROM {_quality('comm')} CROSS JOIN two",
    "modularity_newman": _with("copart", "two AS (SELECT CAST(sum(k) AS BIGINT) AS two_m, CAST((SELECT sum(t * t) FROM tot) AS DOUBLE) AS sq FROM deg)")
    + f"SELECT intra, two_m, CAST(intra AS DOUBLE) / CAST(two_m AS DOUBLE) - sq / (CAST(two_m AS DOUBLE) * CAST(two_m AS DOUBLE)) AS q FROM {_quality('comm')} CROSS JOIN two",
    "quality_report": _with(
        "copart",
        _moves(),
        _APPLIED,
        f"qa AS (SELECT {_Q} AS q0 FROM {_quality('comm')} CROSS JOIN two), qb AS (SELECT {_Q} AS q1 FROM {_quality('applied')} CROSS JOIN two)",
    )
    + "SELECT q0, q1, q1 - q0 AS dq, CASE WHEN q0 = 0 THEN 0.0 ELSE 100 * (q1 - q0) / abs(q0) END AS pct FROM qa CROSS JOIN qb",
    "dense_communities": _with("copart", _FIRST) + "SELECT c, new_c FROM dc",
    "contract_edges": _with("copart", _CONTRACTED) + "SELECT src, dst FROM small",
    "contract_degree": _with("copart", _CONTRACTED) + "SELECT src AS v, count(*) AS k FROM small GROUP BY src",
    "contract_weighted": _with("copart", _CONTRACTED) + "SELECT a AS src, b AS dst, count(*) AS w FROM mapped GROUP BY a, b",
    "flatten_membership": _with("copart", _FIRST) + "SELECT comm.v AS orig, dc.new_c % 5 AS c FROM comm JOIN dc ON dc.c = comm.c",
    "affected_vertices": _with("user_next", _UPDATES) + "SELECT owner_u AS owner, src AS v FROM res UNION SELECT owner_v, dst FROM res",
    "affected_communities": _with("user_next", _UPDATES) + "SELECT c_owner_u AS owner, c_u AS c FROM res UNION SELECT c_owner_v, c_v FROM res",
    "candidate_communities": _with("user_next", _UPDATES) + "SELECT owner_u AS owner, c_v AS c, count(*) AS n FROM res WHERE op = 'INSERT' AND c_u <> c_v GROUP BY owner_u, c_v",
    "remote_notifications": _with("user_next", _UPDATES)
    + "SELECT owner_u AS from_owner, c_v AS c, c_owner_v AS to_owner, count(*) AS n FROM res WHERE op = 'INSERT' AND c_u <> c_v AND owner_u <> owner_v GROUP BY owner_u, c_v, c_owner_v",
    "update_routing": _with("user_next", _UPDATES) + "SELECT owner_u AS owner, update_idx FROM res UNION SELECT owner_v, update_idx FROM res",
    "apply_updates": f"""WITH {GRAPHS['copart'].replace('edges AS', 'base AS')}, {GRAPHS['user_next']},
gone AS (SELECT DISTINCT src, dst FROM edges WHERE event_type = 'error'),
after AS (SELECT base.src, base.dst FROM base ANTI JOIN gone ON gone.src = base.src AND gone.dst = base.dst UNION ALL SELECT src, dst FROM edges WHERE event_type <> 'error')
SELECT src, dst, count(*) AS multiplicity FROM after GROUP BY src, dst""",
    "stream_affected": _with("user_next", _UPDATES)
    + """SELECT 'vertices' AS kind, owner_u AS owner, src AS id FROM res UNION SELECT 'vertices', owner_v, dst FROM res
UNION SELECT 'communities', c_owner_u, c_u FROM res UNION SELECT 'communities', c_owner_v, c_v FROM res""",
}
