"""SQL twins of the queries over files, for DuckDB. They never read a file: what must come out is stated from the keys that the files are made of."""

from __future__ import annotations

from .oracle import DEFAULT, HALVES, L3, READINGS, scores
from .samples import BROKEN, FOLDERS, TEXTS

EXT = "['" + "', '".join(TEXTS) + "'][p_partkey % 13 + 1]"
FOLDER = "['" + "', '".join(FOLDERS) + "'][p_partkey // 13 % 5 + 1]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chosen(values: list[str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def filled(x: str) -> str:
    return f"replace(replace(replace({x}, '{{k}}', p_partkey::VARCHAR), '{{p}}', (p_partkey - 1)::VARCHAR), '{{o}}', ((p_partkey * 7 + 3) % 100)::VARCHAR)"


BROKEN_FILE = "p_partkey % 13 = 6 AND p_partkey % 7 = 0"
TEXT = filled(f"CASE WHEN {BROKEN_FILE} THEN {quoted(BROKEN)} ELSE {chosen(list(TEXTS.values()), 'p_partkey % 13')} END")
FILES = f"files AS (SELECT p_partkey, {FOLDER} || '/f' || p_partkey || {EXT} AS path, {EXT} AS ext, {TEXT} AS text FROM part)"

#: By hand, in the order of TEXTS: what stands in each kind of file.
IDENTIFIERS = [
    "makeT{o} makeT{k} size", "x{k} makeT{p} View{k} props Props", "a{k} require module exports run", "Box{k} Base draw edge{k}", "count{k}", "s{k} b{k}",
    "m{o} x{k} y{k} Cls{k} run{k} self", "p Do{k} n Count T{k} Name Label", "require Shelf{k} pick{k} name size", "Cart{k} total{k} Item item price", "Pump{k} rate drain{k} p",
    "greet{k} name Host{k}", "Gate{k} Open{k} Pass pass Valid",
]
DEFINITIONS = ["", "", "", "", "", "", "Cls{k} run{k}", "Do{k} T{k}", "Shelf{k} pick{k}", "Cart{k} total{k}", "Pump{k} drain{k}", "greet{k} Host{k}", "Gate{k} Open{k}"]
IMPORTS = ["0:./t{o}.js", "0:react 0:./f{p}", "0:./a{o}", "", "0:./m{o}.mjs", "", "1:m{o} 1:y{k}", "", "0:./r{o}", "", "", "", ""]


def names(values: list[str], broken: str) -> str:
    """Sorted and joined by commas."""
    x = filled(f"CASE WHEN {BROKEN_FILE} THEN {quoted(broken)} ELSE {chosen(values, 'p_partkey % 13')} END")
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))), ',')"


FORMS = """k AS (SELECT p_partkey AS k, p_partkey % 19 AS form FROM part),
t AS (SELECT k, CASE WHEN form = 0 THEN 't' || k || '.js' ELSE 't' || k || CASE WHEN (form - 1) % 3 = 2 THEN '/index' ELSE '' END || ['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs'][(form - 1) // 3 + 1] END AS target FROM k),
e AS (SELECT 'src/p' || k || '.ts' AS a, 'src/' || target AS b FROM t
  UNION ALL SELECT 'py/in/p' || k || '.py', 'py/in/q' || k || CASE WHEN k % 2 = 0 THEN '.py' ELSE '/__init__.py' END FROM k
  UNION ALL SELECT 'py/in/p' || k || '.py', 'py/in/w' || k || '.py' FROM k
  UNION ALL SELECT 'py/in/p' || k || '.py', 'py/up.py' FROM k
  UNION ALL SELECT 'rb/r' || k || '.rb', 'rb/s' || k || '.ts' FROM k)"""

#: Files of the sample tree that are walked, by key and kind (place in TEXTS).
LIVE = "live AS (SELECT p_partkey AS k, p_partkey % 13 AS e, " + f"{FOLDER} || '/f' || p_partkey || {EXT} AS path FROM part WHERE p_partkey // 13 % 5 <> 4)"
SIGNALS = """nat AS (SELECT n_nationkey::BIGINT AS n, lower(n_name) AS capability, n_name AS label FROM nation),
found AS (
  SELECT n, 'makeT' || 13 * n AS signal, path FROM nat, live WHERE n % 2 = 0 AND (k = 13 * n OR e = 0 AND (7 * k + 3) % 100 = 13 * n OR e = 1 AND k - 1 = 13 * n)
  UNION ALL SELECT n, 'View' || (13 * n + 1), path FROM nat JOIN live ON k = 13 * n + 1
  UNION ALL SELECT n, 'Box' || (13 * n + 3), path FROM nat JOIN live ON k = 13 * n + 3 WHERE n % 2 = 0
  UNION ALL SELECT n, 'Do' || (13 * n + 7), path FROM nat JOIN live ON k = 13 * n + 7 WHERE n % 2 = 1
  UNION ALL SELECT n, 'run' || (13 * n + 6), path FROM nat JOIN live ON k = 13 * n + 6 WHERE n % 2 = 1 AND k % 7 <> 0),
syms AS (
  SELECT n, 'maket' || k AS sym FROM nat JOIN live ON k = 13 * n WHERE n % 2 = 0
  UNION ALL SELECT n, 'view' || k FROM nat JOIN live ON k = 13 * n + 1
  UNION ALL SELECT n, 'box' || k FROM nat JOIN live ON k = 13 * n + 3 WHERE n % 2 = 0),
sym_links AS (
  SELECT 'maket' || a.k AS a, 'maket' || b.k AS b FROM live a JOIN live b ON a.e = 0 AND b.e = 0 AND b.k = (7 * a.k + 3) % 100 AND a.k <> b.k
  UNION SELECT 'view' || a.k, 'maket' || b.k FROM live a JOIN live b ON a.e = 1 AND b.k = a.k - 1
  UNION SELECT 'box' || k, 'draw' FROM live WHERE e = 3),
sym_both AS (SELECT a, b FROM sym_links UNION SELECT b, a FROM sym_links),
sym_walk AS (SELECT DISTINCT sym AS source, sym AS node, 0 AS hops FROM syms UNION SELECT source, b, hops + 1 FROM sym_walk JOIN sym_both ON node = a WHERE hops < 8),
sym_hops AS (SELECT source, node, min(hops) AS hops FROM sym_walk GROUP BY ALL),
sym_d AS (SELECT a.n, avg(coalesce(h.hops / (h.hops + 2)::DOUBLE, 1.0::DOUBLE)) AS d FROM syms a JOIN syms b ON a.n = b.n AND a.sym < b.sym LEFT JOIN sym_hops h ON h.source = a.sym AND h.node = b.sym GROUP BY a.n),
own AS (SELECT DISTINCT f.n, f.path, l.k, l.e FROM found f JOIN live l ON l.path = f.path),
file_d AS (SELECT n, CASE WHEN (SELECT count(*) FROM own o WHERE o.n = x.n) = 1 THEN 0.0::DOUBLE ELSE (SELECT avg(CASE WHEN b.k = a.k + 1 AND b.e = 1 THEN 1 / 3.0::DOUBLE ELSE 1.0::DOUBLE END) FROM own a JOIN own b ON a.n = b.n AND a.k < b.k WHERE a.n = x.n) END AS d FROM (SELECT DISTINCT n FROM own) x),
dist AS (SELECT nat.n, coalesce(s.d, f.d) AS d FROM nat LEFT JOIN sym_d s ON s.n = nat.n LEFT JOIN file_d f ON f.n = nat.n)"""

CUSTOMERS = """cust AS (SELECT n, c_custkey, c_mktsegment AS tag, c_custkey % 2 = 0 AS tagged, c_mktsegment <> 'MACHINERY' AND c_acctbal >= 0 AS arrow,
  CASE WHEN c_acctbal > 9000 THEN 25 WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 10 WHEN c_mktsegment = 'MACHINERY' THEN 4 WHEN c_mktsegment = 'HOUSEHOLD' THEN 6 ELSE 10 END AS tenths FROM customer JOIN nat ON n = c_nationkey),
tags AS (SELECT n, max(c) / sum(c)::DOUBLE AS coherence FROM (SELECT n, tag, count(*) AS c FROM cust WHERE arrow AND tagged GROUP BY ALL) GROUP BY n),
asked AS (SELECT c.n, count(*) AS n_events, sum(tenths) / 10.0::DOUBLE AS demand, sum(CASE WHEN arrow THEN tenths ELSE 0 END) / sum(tenths)::DOUBLE AS arrow_share, bool_or(arrow AND tagged) AS direction_known, coalesce(max(t.coherence), 0.5::DOUBLE) AS coherence FROM cust c LEFT JOIN tags t ON t.n = c.n GROUP BY c.n),
used AS (SELECT n, sum(greatest(0, s_acctbal / 100)::DECIMAL(24, 6))::DOUBLE AS usage_total FROM supplier JOIN nat ON n = s_nationkey GROUP BY n),
capacity_ AS (SELECT n, count(DISTINCT signal) AS n_matched, count(DISTINCT path) AS n_files, string_agg(DISTINCT path, ',' ORDER BY path) AS files, string_agg(DISTINCT signal, ',' ORDER BY signal) AS matched FROM found GROUP BY n),
evi AS (SELECT nat.n AS ord, capability, CASE WHEN nat.n % 2 = 0 THEN 4 ELSE 3 END AS declared, coalesce(demand, 0.0::DOUBLE) AS demand, coalesce(coherence, 0.0::DOUBLE) AS coherence, coalesce(arrow_share, 0.0::DOUBLE) AS arrow_share, coalesce(direction_known, FALSE) AS direction_known,
  coalesce(n_matched, 0) AS n_matched, coalesce(n_files, 0) AS n_files, usage_total IS NOT NULL AS known, coalesce(usage_total, 0.0::DOUBLE) AS usage_total, label, files, matched, coalesce(n_events, 0) AS n_events
  FROM nat LEFT JOIN asked ON asked.n = nat.n LEFT JOIN capacity_ ON capacity_.n = nat.n LEFT JOIN used ON used.n = nat.n)"""


def r4(x: str) -> str:
    return f"floor(({x}) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE"


def r6(x: str) -> str:
    return f"floor(({x}) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE"


SAYS = """CASE category WHEN 'candidate-unverified' THEN 'Wanted and buildable, but its use is unknown: check that it isn''t in use already.' WHEN 'uncollapsed-feature' THEN 'Wanted and buildable, and hardly used.' WHEN 'unsupported-wish' THEN 'Wanted, but the code has little to build it from.'
  WHEN 'dormant-capacity' THEN 'Buildable, but nobody asks for it.' WHEN 'already-collapsed' THEN 'There, and in use.' ELSE 'No strong pressure.' END"""
NEARNESS = "CASE WHEN d <= 0.1 THEN 'CO-LOCATED' WHEN d <= 0.45 THEN 'RIPE' WHEN d >= 0.75 THEN 'DEEP' WHEN d IS NOT NULL THEN 'MODERATE' END"
SCANNED = f"WITH RECURSIVE {LIVE}, {SIGNALS}, {CUSTOMERS}, {scores('sc', 'evi', DEFAULT)}, shown AS (SELECT sc.*, e.label, e.files, e.matched, e.n_events, e.demand AS raw_demand, e.coherence AS raw_coherence, e.arrow_share AS raw_share, e.direction_known AS raw_known, {r4('d')} AS d FROM sc JOIN evi e USING (ord) JOIN dist ON dist.n = ord)"
ROUND = "floor(({x}) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE"
SIX = "correction, capacity, utilization, score, collapse_potential, confidence"

#: Clusters of what customers ask for, by c_custkey % 6; signals with their places, and which of them the tree's identifiers hold.
SUBJECTS = f"""cl AS (SELECT c_custkey, c_custkey % 6 AS m, (c_custkey % 6) // 2 AS g FROM customer WHERE c_custkey % 6 < 5),
words AS (SELECT g, unnest(list_distinct(string_split(CASE m WHEN 0 THEN 'please draw price label' WHEN 1 THEN 'draw price label once' WHEN 2 THEN 'open host gate' WHEN 3 THEN 'open host gate quickly' ELSE 'water pump drain' END, ' '))) AS word FROM cl),
counted AS (SELECT g, word, count(*) AS c FROM words GROUP BY ALL),
kept AS (SELECT *, max(c) OVER (PARTITION BY g) AS top FROM counted), placed AS (SELECT g, word, row_number() OVER (PARTITION BY g ORDER BY c DESC, word) AS place FROM kept WHERE c >= 2 OR top < 2),
sig AS (SELECT g, list(word ORDER BY place) AS s FROM placed WHERE place <= 6 GROUP BY g),
hits AS (SELECT g, count(DISTINCT word) AS n_matched, count(DISTINCT path) AS n_files FROM placed JOIN live ON place <= 6 AND (word = 'draw' AND e = 3 OR word = 'label' AND e = 7 OR word = 'price' AND e = 9) GROUP BY g),
prop AS (SELECT sig.g, s, count(*) AS n_members, min(c_custkey) AS first, 'emergent-' || array_to_string(s[1:3], '-') AS id FROM sig JOIN cl USING (g) GROUP BY ALL),
evi AS (SELECT row_number() OVER (ORDER BY n_members DESC, id, first) AS ord, id AS capability, len(s) AS declared, n_members::DOUBLE AS demand, 0.5::DOUBLE AS coherence, 1.0::DOUBLE AS arrow_share, FALSE AS direction_known, coalesce(n_matched, 0) AS n_matched, coalesce(n_files, 0) AS n_files,
  FALSE AS known, 0.0::DOUBLE AS usage_total, s, n_members, first FROM prop LEFT JOIN hits USING (g))"""

CHAIN = """f AS (SELECT 'pkg/m' || p_partkey || '.py' AS path, p_partkey AS k FROM part UNION ALL SELECT 'pkg/m' || p_partkey || '/__init__.py', p_partkey FROM part WHERE p_partkey % 5 = 0),
holder AS (SELECT k, max(path) AS target FROM f GROUP BY k), links AS (SELECT f.path, h.target FROM f JOIN holder h ON h.k = f.k + 1),
mods AS (SELECT path, 'pkg.m' || k AS module, (SELECT count(*) FROM links l WHERE l.target = f.path) AS in_degree, (SELECT count(*) FROM links l WHERE l.path = f.path) AS out_degree FROM f)"""

SQL = {
    "tree_files": f"WITH {FILES} SELECT path, ext, length(text) AS n_chars, md5(text) AS digest FROM files WHERE path NOT LIKE 'node_modules/%'",
    "tree_lexers": f"WITH {FILES} SELECT path, {names(IDENTIFIERS, 'total{k} other{k}')} AS identifiers, {names(DEFINITIONS, '')} AS definitions, {names(IMPORTS, '')} AS imports FROM files",
    "import_forms": f"WITH {FORMS} SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e",
    "scan": f"{SCANNED} SELECT capability, {SIX}, known, category, rank, {SAYS} AS interpretation, {NEARNESS} AS integration, d AS integration_distance, coalesce(files, '') AS files, coalesce(matched, '') AS matched, n_events, {ROUND.format(x='raw_demand')} AS demand, {ROUND.format(x='raw_coherence')} AS coherence, raw_known AS direction_known FROM shown",
    "quadrant": f"{SCANNED} SELECT capability, label, d AS x, score AS y, CASE WHEN d <= 0.45 THEN 'ripe' WHEN d >= 0.75 THEN 'deep' ELSE 'moderate' END AS side FROM shown WHERE d IS NOT NULL AND score > 0.001",
    "badges": f"{SCANNED} SELECT capability, {NEARNESS} AS distance, NOT known AS unverified, CASE WHEN n_events > 0 AND {ROUND.format(x='raw_share')} < 0.999 THEN floor((1 - {ROUND.format(x='raw_share')}) * 100 + 0.5)::BIGINT END AS heat_percent, {SAYS} AS interpretation FROM shown",
    "symbol_distances": f"WITH RECURSIVE {LIVE}, {SIGNALS} SELECT capability AS owner, {r4('d')} AS distance FROM sym_d JOIN nat USING (n)",
    "file_distances": f"WITH {LIVE}, own AS (SELECT (k // 13)::INT AS owner, k, e FROM live WHERE k // 13 < 25) SELECT owner, {r4('CASE WHEN count(*) = 1 THEN 0.0::DOUBLE ELSE (count(*) * (count(*) - 1) / 2 - coalesce((SELECT count(*) FROM own a JOIN own b ON a.owner = b.owner AND b.k = a.k + 1 AND b.e = 1 WHERE a.owner = own.owner), 0) * 2 / 3.0::DOUBLE) / (count(*) * (count(*) - 1) / 2) END')} AS distance FROM own GROUP BY owner",
    "discovered": f"""WITH {LIVE}, {SUBJECTS}, {scores('sc', 'evi', DEFAULT)} SELECT sc.capability, array_to_string(list_transform(s[1:3], lambda t: upper(t[1]) || t[2:]), ' / ') || CASE WHEN n_members > 1 THEN ' (×' || n_members || ')' ELSE '' END AS label, ord::INT AS place, rank, {SIX}, category,
      CASE WHEN e.n_files = 1 THEN 'CO-LOCATED' WHEN e.n_files > 1 THEN 'DEEP' END AS integration, array_to_string(s, ',') AS signals, n_members, 'c' || first AS first_member FROM sc JOIN evi e USING (ord)""",
    "reflection_cards": f"""{L3}, both_ AS (SELECT two.*, three.* EXCLUDE (capability), row_number() OVER (ORDER BY baseline_cp DESC, ord) AS place FROM two JOIN three USING (capability) JOIN (SELECT capability, ord FROM caps) o USING (capability))
      SELECT capability, place, CASE WHEN candidate_share > 0.05 AND candidate_share < 0.95 THEN knob END AS knob, {r6('candidate_share')} AS candidate_share, {r6('min_share')} AS min_share, {r6('max_share')} AS max_share, {r6('candidate_share')} AS l2_share, spread <= 0.35 AS class_converges, baseline_cp >= 0.01 AS is_printed FROM both_ WHERE baseline_cp >= 0.001 OR candidate_share > 0.05""",
    "module_places": f"WITH {CHAIN} SELECT path, module, 1 AS n_defs, 'f' AS defs, in_degree, out_degree, row_number() OVER (ORDER BY in_degree DESC, path) AS place FROM mods",
    "module_totals": f"WITH {CHAIN} SELECT count(*) AS n_modules, sum(out_degree)::BIGINT AS n_links, count(*) AS n_definitions, (SELECT count(*) FROM part WHERE p_partkey % 4 = 0) AS n_tests FROM mods",
    "baseline_changes": f"""{HALVES} SELECT capability, {r6('p')} AS d_collapse_potential, {r6('c')} AS d_correction, {r6('u')} AS d_utilization, CASE WHEN p <= -0.1 AND u > 0 THEN 'collapsed' WHEN p <= -0.1 THEN 'decaying' WHEN p >= 0.1 THEN 'intensifying' ELSE 'stable' END AS verdict, row_number() OVER (ORDER BY abs(p) DESC, capability) AS place
      FROM change JOIN (SELECT capability FROM r0 WHERE known) k USING (capability)""",
    "report_rows": f"{READINGS} SELECT capability, score, category, rank FROM rd",
    "seeded": "SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM part",
}
