"""SQL twins of the registered queries, for DuckDB over the same tables. Written apart from the plans they check."""

from __future__ import annotations

from ..functions.lexers import GENERIC_KEYWORDS
from ..functions.scalars import STOPWORDS
from ..operators.proposals import CODE_KEYWORDS


def listed(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def r(x: str, places: int = 3) -> str:
    """Half up, as both sides round."""
    k = f"{10**places}::DOUBLE"
    return f"floor(({x}) * {k} + 0.5) / {k}"


def sat(v: str, h: str) -> str:
    return f"(CASE WHEN ({v}) > 0 AND ({h}) > 0 THEN 1.0::DOUBLE - exp(-(({v})::DOUBLE) / ({h})::DOUBLE) ELSE 0.0::DOUBLE END)"


def clamp(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x})) END)"


def singular(w: str) -> str:
    return f"(CASE WHEN length({w}) > 4 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END)"


def parts(x: str) -> str:
    return f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"


def text_ids(x: str) -> str:
    for pattern in (r"/\*[\s\S]*?\*/", r'"(?:[^"\\]|\\.)*"', r"''(?:[^''\\]|\\.)*''", r"`(?:[^`\\]|\\.)*`", r"//[^\n]*", r"#[^\n]*"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return f"list_filter(list_distinct(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*')), lambda w: lower(w) NOT IN ({listed(GENERIC_KEYWORDS)}))"


WORDS = f"list_distinct(list_transform(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({listed(STOPWORDS)})), lambda w: {singular('w')}))"

SIG = """
sig AS (SELECT ord, capability, signal FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY length(signal) DESC, signal) AS n FROM (
  SELECT DISTINCT item_id AS ord, item_id::VARCHAR AS capability, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS signal FROM benchmark)) WHERE n <= 6),
caps AS (SELECT b.item_id AS ord, b.item_id::VARCHAR AS capability, coalesce(s.n, 0) AS declared FROM benchmark b LEFT JOIN (SELECT ord, count(*) AS n FROM sig GROUP BY ord) s ON s.ord = b.item_id)"""

CAPACITY = f"""{SIG},
ids AS (SELECT doc_id, unnest({text_ids('text')}) AS id FROM documents),
vocabulary AS (SELECT id, list_transform({parts('id')}, lambda w: {singular('w')}) AS p FROM (SELECT DISTINCT id FROM ids)),
spaced AS (SELECT id, 'full' AS space, lower(id) AS token FROM vocabulary WHERE len(p) > 0 UNION SELECT id, 'full', array_to_string(p, '') FROM vocabulary WHERE len(p) > 0 UNION SELECT id, 'part', unnest(p) FROM vocabulary),
keys AS (SELECT capability, signal, 'full' AS space, signal AS token FROM sig UNION SELECT capability, signal, 'part', {singular('signal')} FROM sig),
matched AS (SELECT DISTINCT k.capability, k.signal, i.doc_id FROM keys k JOIN spaced s USING (space, token) JOIN ids i USING (id)),
cap AS (SELECT capability, count(DISTINCT signal) AS n_matched, count(DISTINCT doc_id) AS n_files, count(*) AS hits FROM matched GROUP BY capability)"""

EVENTS = """
ev AS (SELECT *, CASE kind WHEN 'correction' THEN 10 WHEN 'request' THEN 10 WHEN 'repetition' THEN 8 WHEN 'workaround' THEN 6 WHEN 'abandonment' THEN 5 ELSE 4 END AS tenths,
         kind NOT IN ('retry', 'abandonment') AS arrow FROM (
  SELECT ts, ((regexp_extract(props, '"k": (\\d+)', 1)::INT % 40) * (event_id % 40)) // 40 AS k, CASE event_type WHEN 'click' THEN 'correction' WHEN 'signup' THEN 'request' WHEN 'purchase' THEN 'repetition' WHEN 'view' THEN 'retry' ELSE 'abandonment' END AS kind,
         CASE WHEN user_id % 10 < 7 THEN '0' ELSE (user_id % 10)::VARCHAR END AS way FROM events))"""


def demand(name: str = "dem", where: str = "TRUE") -> str:
    return f"""
{name}_tags AS (SELECT capability, max(n) / sum(n)::DOUBLE AS coherence FROM (SELECT k::VARCHAR AS capability, way, count(*) AS n FROM ev WHERE arrow AND {where} GROUP BY ALL) GROUP BY capability),
{name} AS (SELECT d.*, coalesce(t.coherence, 0.5::DOUBLE) AS coherence FROM (SELECT k::VARCHAR AS capability, count(*) AS "count", sum(tenths) / 10.0::DOUBLE AS demand,
  CASE WHEN sum(tenths) > 0 THEN sum(CASE WHEN arrow THEN tenths ELSE 0 END) / sum(tenths)::DOUBLE ELSE 0.0::DOUBLE END AS arrow_share, bool_or(arrow) AS direction_known FROM ev WHERE {where} GROUP BY 1) d LEFT JOIN {name}_tags t USING (capability))"""


USE = """
us AS (SELECT (39 - ((l_partkey % 40) * (l_suppkey % 40)) // 40)::VARCHAR AS capability, count(*) * 2 / 100.0::DOUBLE AS usage_total FROM lineitem GROUP BY 1)"""


def evidence(name: str = "evi", dem: str = "dem") -> str:
    return f"""
{name} AS (SELECT c.ord, c.capability, c.declared, coalesce(d.demand, 0.0::DOUBLE) AS demand, coalesce(d.coherence, 0.0::DOUBLE) AS coherence, coalesce(d.arrow_share, 0.0::DOUBLE) AS arrow_share, coalesce(d.direction_known, FALSE) AS direction_known,
  coalesce(k.n_matched, 0) AS n_matched, coalesce(k.n_files, 0) AS n_files, u.usage_total IS NOT NULL AS known, coalesce(u.usage_total, 0.0::DOUBLE) AS usage_total
  FROM caps c LEFT JOIN {dem} d USING (capability) LEFT JOIN cap k USING (capability) LEFT JOIN us u USING (capability))"""


CATEGORY = """CASE WHEN correction >= {hi} AND capacity >= {hi} AND NOT known THEN 'candidate-unverified' WHEN correction >= {hi} AND capacity >= {hi} AND utilization <= {lo} THEN 'uncollapsed-feature'
  WHEN correction >= {hi} AND capacity <= {lo} THEN 'unsupported-wish' WHEN capacity >= {hi} AND correction <= {lo} AND utilization <= {lo} THEN 'dormant-capacity' WHEN utilization >= {hi} THEN 'already-collapsed' ELSE 'low-signal' END"""
HI_LO = CATEGORY.format(hi="0.6::DOUBLE", lo="0.34::DOUBLE")


def scores(name: str, of: str, configs: str, by: str = "") -> str:
    """Readings of `of` under each row of configs (config_id and the four scales); each value of the column `by` is ranked by itself."""
    return f"""
{name}_raw AS (SELECT {f"e.{by}, " if by else ""}e.ord, e.capability, e.known, g.*, {clamp(f"{sat('demand', 'c_half')} * (0.5::DOUBLE + 0.5::DOUBLE * coherence)")} AS c,
  {clamp(f"CASE WHEN declared > 0 THEN n_matched / declared::DOUBLE ELSE 0.0::DOUBLE END * {sat('n_files', 'k_half')}")} AS kk,
  CASE WHEN known THEN {sat('usage_total', 'u_half')} ELSE 0.0::DOUBLE END AS u,
  CASE WHEN demand > 0 THEN {clamp("(1.0::DOUBLE - exp(-demand / 3.0::DOUBLE)) * arrow_share * CASE WHEN direction_known THEN 0.5::DOUBLE + 0.5::DOUBLE * coherence ELSE 0.5::DOUBLE END")} ELSE 0.0::DOUBLE END AS cc,
  CASE WHEN declared > 0 THEN {clamp("n_matched / declared::DOUBLE")} ELSE 0.0::DOUBLE END AS kc, CASE WHEN known THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS uc FROM {of} e CROSS JOIN {configs} g),
{name}_fields AS (SELECT * EXCLUDE (c, kk, u, cc, kc, uc), {r('c')} AS correction, {r('kk')} AS capacity, {r('u')} AS utilization, {r('c * (cc * kc * uc) * (1 - u)')} AS score,
  {r('c * kk * (1 - CASE WHEN known THEN u ELSE unknown_util_prior END)')} AS collapse_potential, {r('cc * kc * uc')} AS confidence FROM {name}_raw),
{name} AS (SELECT *, {HI_LO} AS category, row_number() OVER (PARTITION BY config_id{f", {by}" if by else ""} ORDER BY score DESC, ord) AS rank FROM {name}_fields)"""


ONE = "(SELECT 0 AS config_id, 150.0::DOUBLE AS c_half, 5.0::DOUBLE AS k_half, 30.0::DOUBLE AS u_half, 0.5::DOUBLE AS unknown_util_prior)"
DEFAULT = "(SELECT 0 AS config_id, 3.0::DOUBLE AS c_half, 2.0::DOUBLE AS k_half, 20.0::DOUBLE AS u_half, 0.5::DOUBLE AS unknown_util_prior)"
BASE = f"WITH {CAPACITY}, {EVENTS}, {demand()}, {USE}, {evidence()}"
READINGS = f"{BASE}, {scores('rd', 'evi', ONE)}"
SHOWN = "capability, correction, capacity, utilization, score, collapse_potential, confidence, known, category, rank"

TURNS = f"WITH {{more}}turns AS (SELECT conv_id, turn, conv_id * 1000 + turn AS ord, {WORDS} AS words FROM conversations WHERE role = 'user'), w AS (SELECT ord, unnest(words) AS token FROM turns)"
USER = TURNS.format(more="")
PAIRS = """sized AS (SELECT *, count(*) OVER (PARTITION BY ord) AS n FROM w),
linked AS (SELECT a.ord AS a, b.ord AS b, count(*) / least(a.n, b.n)::DOUBLE AS overlap FROM sized a JOIN sized b ON a.token = b.token AND a.ord < b.ord GROUP BY a.ord, b.ord, a.n, b.n)"""
WIDE = "co AS (SELECT DISTINCT a.token, b.token AS other FROM w a JOIN w b ON a.ord = b.ord AND a.token <> b.token), wide AS (SELECT ord, token FROM w UNION SELECT ord, other FROM w JOIN co USING (token))"
CLUSTERS = f"""{USER.replace('WITH ', 'WITH RECURSIVE ', 1)}, {WIDE}, {PAIRS.replace('FROM w)', 'FROM wide)')}, edges AS (SELECT a, b FROM linked WHERE overlap >= 0.34 UNION SELECT b, a FROM linked WHERE overlap >= 0.34),
reach AS (SELECT DISTINCT ord AS node, ord AS hit FROM w UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.hit = e.a), cluster AS (SELECT node AS ord, min(hit) AS root FROM reach GROUP BY node)"""
PLAIN = f"""{USER.replace('WITH ', 'WITH RECURSIVE ', 1)}, {PAIRS}, edges AS (SELECT a, b FROM linked WHERE overlap >= 0.6 UNION SELECT b, a FROM linked WHERE overlap >= 0.6),
reach AS (SELECT DISTINCT ord AS node, ord AS hit FROM w UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.hit = e.a), cluster AS (SELECT node AS ord, min(hit) AS root FROM reach GROUP BY node)"""
SIGNALS = f"""{{clusters}}, support AS (SELECT root, token, count(*) AS n FROM w JOIN cluster USING (ord) GROUP BY ALL), usable AS (SELECT *, max(n) OVER (PARTITION BY root) AS top FROM support WHERE token NOT IN ({listed(CODE_KEYWORDS)})),
picked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, token) AS place FROM usable WHERE n >= 2 OR top < 2)"""

PROPOSED = f"""{SIGNALS}, top AS (SELECT root, list(token ORDER BY place) AS s FROM picked WHERE place <= 6 GROUP BY root), sizes AS (SELECT root, count(*) AS n_members FROM cluster GROUP BY root)
      SELECT root, 'emergent-' || array_to_string(s[1:3], '-') AS id, array_to_string(list_transform(s[1:3], lambda t: upper(t[1]) || t[2:]), ' / ') || CASE WHEN n_members > 1 THEN ' (×' || n_members || ')' ELSE '' END AS label, array_to_string(s, ',') AS signals, n_members FROM top JOIN sizes USING (root)"""

LINKS = """lines AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), links AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lines a JOIN lines b USING (l_orderkey) WHERE a.l_suppkey <> b.l_suppkey)"""
HOPS = f"WITH RECURSIVE {LINKS}, walk AS (SELECT s_suppkey AS source, s_suppkey AS node, 0 AS hops FROM supplier WHERE {{where}} UNION SELECT source, dst, hops + 1 FROM walk JOIN links ON node = src WHERE hops < 8), reached AS (SELECT source, node, min(hops) AS hops FROM walk GROUP BY ALL)"
DISTANCE = f"""{HOPS.format(where='TRUE')}, pairs AS (SELECT a.s_nationkey AS owner, coalesce(h.hops / (h.hops + 2)::DOUBLE, 1.0::DOUBLE) AS d FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey LEFT JOIN reached h ON h.source = a.s_suppkey AND h.node = b.s_suppkey),
distances AS (SELECT s_nationkey AS owner, count(*) AS n_nodes, coalesce((SELECT avg(d) FROM pairs p WHERE p.owner = s_nationkey), 0.0::DOUBLE) AS distance FROM supplier GROUP BY s_nationkey)"""
DEGREES = f"{LINKS}, deg AS (SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM links WHERE src < dst UNION ALL SELECT dst, 0, 1 FROM links WHERE src < dst) GROUP BY node)"


def values(name: str, levels: list[float]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(levels)) + f") AS v_{name}(i_{name}, {name})"


GRID = "(SELECT ((i_c_half * 3 + i_k_half) * 3 + i_u_half) * 3 + i_unknown_util_prior AS config_id, c_half, k_half, u_half, unknown_util_prior FROM " + ", ".join(
    values(k, v) for k, v in (("c_half", [1.5, 3.0, 6.0]), ("k_half", [1.0, 2.0, 4.0]), ("u_half", [10.0, 20.0, 40.0]), ("unknown_util_prior", [0.3, 0.5, 0.7]))
) + ")"
THRESHOLDS = f"{values('hi', [0.5, 0.6, 0.7])}, {values('lo', [0.25, 0.34, 0.45])}"
SWEEP = f"""{BASE}, {scores('sw', 'evi', GRID)}, {scores('bs', 'evi', DEFAULT)},
tally AS (SELECT * EXCLUDE (category), {CATEGORY.format(hi='hi', lo='lo')} IN ('uncollapsed-feature', 'candidate-unverified') AS candidate FROM sw CROSS JOIN {THRESHOLDS}),
cells AS (SELECT capability, knob, knob_ord, level, count(*) AS t, sum(candidate::INT)::BIGINT AS c FROM (SELECT capability, candidate, unnest(['c_half', 'k_half', 'u_half', 'unknown_util_prior', 'hi', 'lo']) AS knob, unnest([0, 1, 2, 3, 4, 5]) AS knob_ord, unnest([c_half, k_half, u_half, unknown_util_prior, hi, lo]) AS level FROM tally) GROUP BY ALL),
stats AS (SELECT capability, count(*) AS configurations, avg((rank = 1)::INT) AS rank1_share, avg(candidate::INT) AS candidate_share, min(collapse_potential) AS cp_min, max(collapse_potential) AS cp_max FROM tally GROUP BY capability)"""
L2 = f"""{SWEEP}, spreads AS (SELECT capability, knob, knob_ord, max(c) - min(c) AS spread, arg_min(level, (c, level)) AS low_level, arg_max(level, (c, level)) AS high_level FROM cells GROUP BY ALL),
best AS (SELECT * FROM spreads WHERE spread > 0 QUALIFY row_number() OVER (PARTITION BY capability ORDER BY spread DESC, knob_ord) = 1),
two AS (SELECT b.capability, b.collapse_potential AS baseline_cp, b.rank AS baseline_rank, b.category AS baseline_category, s.* EXCLUDE (capability), knob, low_level, high_level FROM bs b JOIN stats s USING (capability) LEFT JOIN best USING (capability))"""
PLACE = "CASE WHEN rank1_share >= 0.8 THEN 'always first; ' WHEN rank1_share >= 0.2 THEN 'sometimes first; ' ELSE '' END"
VERDICT = f"CASE WHEN baseline_cp < 0.01 AND candidate_share < 0.05 THEN 'never a candidate' WHEN candidate_share <= 0.2 THEN 'stable non-candidate' WHEN candidate_share >= 0.8 THEN {PLACE} || 'robust' WHEN candidate_share >= 0.5 THEN {PLACE} || 'mostly robust' ELSE {PLACE} || 'fragile' END"

FACTOR = "exp(ln({a}::DOUBLE) + i * ((ln({b}::DOUBLE) - ln({a}::DOUBLE)) / {m}::DOUBLE))"


def design(k: int, radius: str, n: int) -> str:
    (a, b), (p, q) = {"narrow": ((0.75, 1.333), (0.4, 0.6)), "medium": ((0.5, 2.0), (0.3, 0.7)), "wide": ((0.333, 3.0), (0.2, 0.8))}[radius]
    f = FACTOR.format(a=a, b=b, m=n - 1)
    knob = ", ".join(f"(SELECT i AS i{j}, {f} * {v}::DOUBLE AS x{j} FROM range({n}) t(i))" for j, v in enumerate((3.0, 2.0, 20.0)))
    prior = f"(SELECT i AS i3, {p}::DOUBLE + i * (({q}::DOUBLE - {p}::DOUBLE) / {n - 1}::DOUBLE) AS x3 FROM range({n}) t(i))"
    return f"SELECT {k} AS design, {k * 10000} + ((i0 * {n} + i1) * {n} + i2) * {n} + i3 AS config_id, x0 AS c_half, x1 AS k_half, x2 AS u_half, x3 AS unknown_util_prior FROM {knob}, {prior}"


DESIGNS = " UNION ALL ".join(design(k, radius, n) for k, (radius, n) in enumerate((x, n) for x in ("narrow", "medium", "wide") for n in (3, 5)))
L3 = f"""{L2}, designs AS ({DESIGNS}), {scores('ds', 'evi', 'designs')},
per AS (SELECT capability, design, avg((category IN ('uncollapsed-feature', 'candidate-unverified'))::INT) AS share, avg((rank = 1)::INT) AS rank1 FROM ds GROUP BY ALL),
three AS (SELECT capability, min(share) AS min_share, max(share) AS max_share, avg(share) AS mean_share, max(share) - min(share) AS spread, min(rank1) AS rank1_min FROM per GROUP BY capability)"""

PARTS = f"""WITH tags AS (SELECT l_partkey, max(n) / sum(n)::DOUBLE AS coherence FROM (SELECT l_partkey, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL) GROUP BY 1),
sums AS (SELECT l_partkey, sum(l_quantity) / 10.0::DOUBLE AS demand, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) / 10.0::DOUBLE AS arrow_demand, bool_or(l_returnflag <> 'N') AS direction_known, count(DISTINCT l_suppkey) AS n_files, count(DISTINCT l_returnflag) AS n_matched,
  sum(floor(l_discount * 100 + 0.5))::DOUBLE AS usage_total FROM lineitem GROUP BY 1),
evi AS (SELECT p_partkey AS ord, p_partkey::VARCHAR AS capability, 3 AS declared, coalesce(demand, 0.0::DOUBLE) AS demand, CASE WHEN demand IS NULL THEN 0.0::DOUBLE ELSE coalesce(coherence, 0.5::DOUBLE) END AS coherence, CASE WHEN demand > 0 THEN arrow_demand / demand ELSE 0.0::DOUBLE END AS arrow_share,
  coalesce(direction_known, FALSE) AS direction_known, coalesce(n_matched, 0) AS n_matched, coalesce(n_files, 0) AS n_files, usage_total IS NOT NULL AS known, coalesce(usage_total, 0.0::DOUBLE) AS usage_total FROM part LEFT JOIN sums s ON s.l_partkey = p_partkey LEFT JOIN tags t ON t.l_partkey = p_partkey),
{scores('rd', 'evi', '(SELECT 0 AS config_id, 60.0::DOUBLE AS c_half, 10.0::DOUBLE AS k_half, 200.0::DOUBLE AS u_half, 0.5::DOUBLE AS unknown_util_prior)')}"""

HALVES = f"""WITH {CAPACITY}, {EVENTS}, {demand('d0', "ts < TIMESTAMP '2024-01-16'")}, {demand('d1', "ts >= TIMESTAMP '2024-01-16'")}, {USE}, {evidence('e0', 'd0')}, {evidence('e1', 'd1')}, {scores('r0', 'e0', ONE)}, {scores('r1', 'e1', ONE)},
change AS (SELECT capability, r1.collapse_potential - r0.collapse_potential AS p, r1.correction - r0.correction AS c, r1.utilization - r0.utilization AS u FROM r0 JOIN r1 USING (capability))"""

PART_NAME = "replace(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), ' ', '') || '_' || p_type || 's' || p_brand"
SPEC_PARTS = "string_split('a.b.c.p' || p_partkey, '.')"
MODULE = f"""CASE WHEN length(regexp_extract(spec, '^(\\.*)', 1)) = 0 THEN spec ELSE array_to_string(list_concat(({SPEC_PARTS})[1:greatest(0, len({SPEC_PARTS}) - length(regexp_extract(spec, '^(\\.*)', 1)))],
  CASE WHEN regexp_replace(spec, '^\\.+', '') <> '' THEN string_split(regexp_replace(spec, '^\\.+', ''), '.') ELSE [] END), '.') END"""
TEST_PATH = "CASE p_partkey % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/test/' WHEN 2 THEN 'contest/' ELSE '' END || CASE p_size % 4 WHEN 0 THEN 'test_a' WHEN 1 THEN 'a_test' WHEN 2 THEN 'conftest' ELSE 'main' END || '.py'"


def board(side: int) -> str:
    return f"cells AS (SELECT range AS cell FROM range({side * side})), near AS (SELECT c.cell, y * {side} + x AS near FROM (SELECT cell, cell % {side} + dx AS x, cell // {side} + dy AS y FROM cells, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) c WHERE x >= 0 AND x < {side} AND y >= 0 AND y < {side})"


#: The whole board is one row of lists, and each round of the recursion draws on all clues at once; more rounds than it takes change nothing.
PUZZLE = f"""WITH RECURSIVE {board(20)}, filled AS (SELECT p_partkey % 400 AS cell, (max(p_size) > 40)::INT AS value FROM part GROUP BY 1),
given AS (SELECT n.cell, sum(value)::INT AS clue FROM near n JOIN filled f ON f.cell = n.near GROUP BY n.cell),
packed AS (SELECT list(g.clue ORDER BY c.cell) AS clue, list(c.near ORDER BY c.cell) AS near FROM (SELECT cell, list(near) AS near FROM near GROUP BY cell) c LEFT JOIN given g USING (cell)),
solve AS (SELECT 0 AS k, list_transform(range(400), lambda c: NULL::INT) AS state UNION ALL
  SELECT k + 1, list_transform(range(1, 401), lambda c: coalesce(state[c], list_max(list_transform(near[c], lambda i: drawn[i + 1])))) FROM (
    SELECT k, state, near, list_transform(range(1, 401), lambda c: CASE WHEN clue[c] IS NULL OR len(list_filter(near[c], lambda j: state[j + 1] IS NULL)) = 0 THEN NULL
      WHEN list_sum(list_transform(near[c], lambda j: coalesce(state[j + 1], 0))) = clue[c] THEN 0
      WHEN list_sum(list_transform(near[c], lambda j: coalesce(state[j + 1], 1))) = clue[c] THEN 1 END) AS drawn FROM solve, packed WHERE k < 40))
SELECT (c - 1)::INT AS cell, state[c] AS state FROM solve, range(1, 401) t(c) WHERE k = 40"""

CUBE = """WITH s AS (SELECT count(*)::INT AS n FROM region), c AS (SELECT range::INT AS cell, n, range // (n * n) AS f, (range // n) % n AS y, range % n AS x FROM s, range(6 * (SELECT n * n FROM s))),
e AS (SELECT cell, f, n, 2 * x + a AS u, 2 * y + b AS v FROM c, (VALUES (1, 0), (1, 2), (0, 1), (2, 1)) t(a, b)),
p AS (SELECT cell, CASE f // 2 WHEN 0 THEN [(f % 2) * 2 * n, u, v] WHEN 1 THEN [u, (f % 2) * 2 * n, v] ELSE [u, v, (f % 2) * 2 * n] END AS at FROM e),
near AS (SELECT DISTINCT a.cell, b.cell AS near FROM p a JOIN p b ON a.at = b.at WHERE a.cell <> b.cell) SELECT cell, count(*) AS n_near, sum(near)::BIGINT AS sum_near FROM near GROUP BY cell"""

SCRIPTS = "parts AS (SELECT p_partkey AS k, (p_partkey * 7 + 3) % 100 AS o FROM part), both_ways AS (SELECT k AS a, o AS b FROM parts WHERE o IN (SELECT k FROM parts) AND o <> k), edges AS (SELECT a, b FROM both_ways UNION SELECT b, a FROM both_ways)"
MODULES = """m AS (SELECT p_partkey AS k, p_size // 10 + 1 AS n_defs FROM part), l AS (SELECT DISTINCT k, t FROM (SELECT k, k % 10 AS t FROM m UNION ALL SELECT k, k % 3 FROM m) WHERE t <> k AND t IN (SELECT k FROM m)),
d AS (SELECT 'pkg.m' || k AS module, n_defs, (SELECT count(*) FROM l WHERE l.t = m.k) AS in_degree, (SELECT count(*) FROM l WHERE l.k = m.k) AS out_degree FROM m)"""

SQL = {
    "readings": f"{READINGS} SELECT {SHOWN} FROM rd",
    "signal_kind_join": f"WITH {EVENTS} SELECT kind, count(*) AS n, sum(tenths) / 10.0::DOUBLE AS weight, count(*) FILTER (arrow) AS n_arrows FROM ev GROUP BY kind",
    "demand_agg": f"WITH {EVENTS}, {demand()} SELECT capability, \"count\", demand, {r('arrow_share', 6)} AS arrow_share FROM dem",
    "coherence": f"WITH {EVENTS}, {demand()} SELECT capability, {r('coherence', 6)} AS coherence, direction_known FROM dem",
    "usage_known": f"WITH {SIG}, {USE} SELECT capability, usage_total, usage_total IS NOT NULL AS known FROM caps LEFT JOIN us USING (capability)",
    "correction_field": f"WITH {EVENTS}, {demand()} SELECT capability, {r(clamp(sat('demand', '150') + ' * (0.5::DOUBLE + 0.5::DOUBLE * coherence)'))} AS correction FROM dem",
    "scalar_functions": f"""SELECT c_custkey, {clamp('c_acctbal / 5000')} AS clamped, {r('c_acctbal / 7')} AS rounded, {r(sat('c_acctbal', '1000'), 6)} AS saturated,
      {r("exp(ln(0.5::DOUBLE) + (c_nationkey % 5) * ((ln(2.0::DOUBLE) - ln(0.5::DOUBLE)) / 4.0::DOUBLE))", 6)} AS geometric, {r("0.2::DOUBLE + (c_nationkey % 5) * ((0.8::DOUBLE - 0.2::DOUBLE) / 4.0::DOUBLE)", 6)} AS linear FROM customer""",
    "identifier_split": f"SELECT p_partkey, array_to_string({parts('x')}, '|') AS words, array_to_string(list_transform({parts('x')}, lambda w: {singular('w')}), '|') AS parts FROM (SELECT p_partkey, {PART_NAME} AS x FROM part)",
    "text_lexer": f"SELECT page_id, len(ids) AS n_identifiers, md5(array_to_string(list_sort(ids), ',')) AS digest FROM (SELECT page_id, {text_ids('html')} AS ids FROM pages)",
    "tokenize": f"{USER} SELECT conv_id, turn, len(words) AS n_words, array_to_string(list_sort(words), ',') AS words FROM turns",
    "signal_match": f"WITH {CAPACITY} SELECT capability, n_matched, n_files, hits FROM cap",
    "capacity_field": f"WITH {CAPACITY} SELECT capability, {r(clamp('coalesce(n_matched, 0) / nullif(declared, 0)::DOUBLE * ' + sat('coalesce(n_files, 0)', '5')))} AS capacity, {r(clamp('coalesce(n_matched, 0) / nullif(declared, 0)::DOUBLE'))} AS capacity_confidence FROM caps LEFT JOIN cap USING (capability)",
    "part_readings": f"{PARTS} SELECT capability, score, collapse_potential, category, rank FROM rd",
    "top_k": f"{READINGS} SELECT rank, capability, score, category, rpad(repeat('#', floor(score * 10 + 0.5)::INT), 10, '.') AS bar, floor(confidence * 100 + 0.5)::BIGINT || '%' AS confidence FROM rd WHERE rank <= 10",
    "category_counts": f"{READINGS} SELECT category, count(*) AS n, max(score) AS best, count(*) FILTER (category IN ('uncollapsed-feature', 'candidate-unverified')) AS n_candidates FROM rd GROUP BY category",
    "cooccurrence": f"{USER}, co AS (SELECT a.token, b.token AS other, count(*) AS n FROM w a JOIN w b ON a.ord = b.ord AND a.token <> b.token GROUP BY ALL) SELECT token, count(*) AS n_others, sum(n)::BIGINT AS n_pairs, max(n) AS most FROM co GROUP BY token",
    "token_expand": f"{USER}, co AS (SELECT a.token, b.token AS other FROM w a JOIN w b ON a.ord = b.ord AND a.token <> b.token GROUP BY ALL HAVING count(*) >= 3), wide AS (SELECT ord, token FROM w UNION SELECT ord, other FROM w JOIN co USING (token)) SELECT ord, (SELECT count(*) FROM w x WHERE x.ord = wide.ord) AS n_words, count(*) AS n_expanded FROM wide GROUP BY ord",
    "overlap_pairs": f"{USER}, {PAIRS} SELECT a, count(*) AS n_linked, {r('max(overlap)', 6)} AS most FROM linked WHERE overlap >= 0.34 GROUP BY a",
    "components": f"{CLUSTERS} SELECT ord, root FROM cluster",
    "cluster_signals": f"{SIGNALS.format(clusters=CLUSTERS)} SELECT root, token, n, place FROM picked WHERE place <= 6",
    "discover": PROPOSED.format(clusters=CLUSTERS),
    "discover_plain": PROPOSED.format(clusters=PLAIN),
    "set_overlap": f"""{USER}, said AS (SELECT conv_id, turn - 1 AS turn, {WORDS} AS b FROM conversations WHERE role = 'assistant'), both_ AS (SELECT conv_id, turn, words AS a, b, len(list_intersect(words, b)) AS c FROM turns JOIN said USING (conv_id, turn))
      SELECT conv_id, turn, c AS n_common, len(a) + len(b) - c AS n_all, {r('CASE WHEN least(len(a), len(b)) > 0 THEN c / least(len(a), len(b))::DOUBLE ELSE 0.0::DOUBLE END', 6)} AS overlap FROM both_""",
    "bfs_hops": f"{HOPS.format(where='TRUE')} SELECT source, node, hops FROM reached",
    "mean_distance": f"{DISTANCE} SELECT owner, {r('distance', 6)} AS distance, n_nodes FROM distances",
    "integration_label": f"{DISTANCE} SELECT owner, CASE WHEN distance <= 0.1 THEN 'CO-LOCATED' WHEN distance <= 0.45 THEN 'RIPE' WHEN distance >= 0.75 THEN 'DEEP' ELSE 'MODERATE' END AS integration FROM distances",
    "degree": f"WITH {DEGREES} SELECT node, out_degree, in_degree FROM deg",
    "sweep_l2": f"{L2} SELECT capability, baseline_cp, baseline_rank, baseline_category, configurations, {', '.join(f'{r(c, 6)} AS {c}' for c in ('rank1_share', 'candidate_share', 'cp_min', 'cp_max'))}, knob, low_level, high_level, {VERDICT} AS verdict FROM two",
    "sensitivity": f"{SWEEP} SELECT capability, knob, level, t, c FROM cells",
    "sweep_l3": f"{L3} SELECT capability, baseline_cp, {r('candidate_share', 6)} AS l2_share, {', '.join(f'{r(c, 6)} AS {c}' for c in ('min_share', 'max_share', 'mean_share', 'spread', 'rank1_min'))}, spread <= 0.35 AS class_converges FROM two JOIN three USING (capability)",
    "compare_verdict": f"{HALVES} SELECT capability, {r('p', 6)} AS d_collapse_potential, {r('c', 6)} AS d_correction, {r('u', 6)} AS d_utilization, CASE WHEN p <= -0.1 AND u > 0 THEN 'collapsed' WHEN p <= -0.1 THEN 'decaying' WHEN p >= 0.1 THEN 'intensifying' ELSE 'stable' END AS verdict FROM change",
    "module_filters": f"""WITH {DEGREES}, d AS (SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS n_defs FROM lineitem GROUP BY 1), m AS (SELECT s_suppkey AS s, coalesce(n_defs, 0) AS n, coalesce(in_degree, 0) AS i, coalesce(out_degree, 0) AS o FROM supplier LEFT JOIN deg ON node = s_suppkey LEFT JOIN d ON s = s_suppkey)
      SELECT s, i >= 2 AS is_foundation, i = 0 AND o >= 2 AND n > 0 AS is_surface, n >= 5 AND i <= 1 AND o <= 1 AS is_rich, i = 0 AND o = 0 AND n > 0 AS is_isolated FROM m""",
    "python_imports": f"""WITH specs AS (SELECT p_partkey, unnest([repeat('.', p_size % 4) || 'm' || p_size, 'lib.n' || (p_partkey % 7)]) AS spec FROM part), m AS (SELECT *, {MODULE} AS module FROM specs)
      SELECT p_partkey, spec, module, CASE WHEN contains(module, '.') THEN regexp_replace(module, '\\.[^.]*$', '') END AS parent FROM m""",
    "test_files": f"""WITH p AS (SELECT p_partkey, {TEST_PATH} AS path FROM part), n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM p)
      SELECT p_partkey, regexp_matches(path, '(^|/)tests?/') OR starts_with(name, 'test_') OR regexp_matches(name, '_test\\.\\w+$') OR starts_with(name, 'conftest.') AS is_test, replace(regexp_replace(path, '\\.[^.]+$', ''), '/', '.') AS module, 'a/' || path AS plain FROM n""",
    "stencil": f"WITH {board(40)}, filled AS (SELECT p_partkey % 1600 AS cell, (max(p_size) > 40)::INT AS value FROM part GROUP BY 1) SELECT n.cell::INT AS cell, sum(value)::BIGINT AS clue FROM near n JOIN filled f ON f.cell = n.near GROUP BY n.cell",
    "wave": f"WITH RECURSIVE {board(40)}, walk AS (SELECT (n_nationkey * 61 % 1600)::BIGINT AS cell, 0 AS step FROM nation UNION SELECT near, step + 1 FROM walk JOIN near USING (cell) WHERE step < 6) SELECT cell::INT AS cell, min(step) AS step FROM walk GROUP BY cell",
    "cube_surface": CUBE,
    "puzzle_solution": PUZZLE,
    "stream_demand": f"WITH {EVENTS}, {demand()} SELECT capability, \"count\", demand, {r('arrow_share', 6)} AS arrow_share, {r('coherence', 6)} AS coherence, direction_known FROM dem",
    "json_inputs": f"WITH {SIG} SELECT ord::INT AS ord, capability AS id, 'item ' || capability AS label, (SELECT string_agg(signal, ',' ORDER BY length(signal) DESC, signal) FROM sig s WHERE s.ord = caps.ord) AS signals FROM caps",
    "json_arrays": "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1)::INT AS ord, lang AS label, md5(text) AS digest FROM documents",
    "baseline_round_trip": f"{READINGS} SELECT capability, 0.0::DOUBLE AS d_collapse_potential, 0.0::DOUBLE AS d_correction, 0.0::DOUBLE AS d_utilization, 'stable' AS verdict FROM rd",
    "script_lexer": f"WITH {SCRIPTS} SELECT 'src/part' || k || '.ts' AS path, array_to_string(list_sort(list_distinct(['makePart' || k, 'makePart' || o, 'size', 'name', 'length'])), ',') AS identifiers, array_to_string(list_sort(['makePart' || k, 'name']), ',') AS declared, './part' || o || '.js' AS imported FROM parts",
    "import_graph": f"WITH {SCRIPTS} SELECT 'src/part' || a || '.ts' AS src, 'src/part' || b || '.ts' AS dst FROM edges",
    "symbol_graph": f"WITH {SCRIPTS} SELECT 'makepart' || a AS src, 'makepart' || b AS dst FROM edges UNION SELECT 'makepart' || k, 'name' FROM parts UNION SELECT 'name', 'makepart' || k FROM parts",
    "module_map": f"WITH {MODULES} SELECT module, n_defs, in_degree, out_degree, in_degree >= 2 AS is_foundation, in_degree = 0 AND out_degree >= 2 AND n_defs > 0 AS is_surface, n_defs >= 5 AND in_degree <= 1 AND out_degree <= 1 AS is_rich, in_degree = 0 AND out_degree = 0 AND n_defs > 0 AS is_isolated FROM d",
}
