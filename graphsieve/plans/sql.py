"""SQL fragments of the queries' reference statements."""

from __future__ import annotations

from ..functions.columns import SALT_SUFFIXES

_BASE = """links AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, count(*) AS score FROM lineitem GROUP BY 1, 2),
 e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, score FROM links WHERE score >= 2),
 e3 AS (SELECT src, dst FROM e WHERE score >= 3),
 sym AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
 sym3 AS (SELECT src, dst FROM e3 UNION ALL SELECT dst, src FROM e3),
 nodes AS (SELECT DISTINCT src AS node FROM sym),
 nodes3 AS (SELECT DISTINCT src AS node FROM sym3),
 targets AS (SELECT CASE WHEN p_brand = 'Brand#1' THEN 'A' ELSE 'B' END AS compound, 'p' || p_partkey AS node FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7')),
 disease AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size <= 5),
 ex AS (SELECT 'p' || p_partkey AS node, p_retailprice AS x FROM part UNION ALL SELECT 's' || s_suppkey, greatest(s_acctbal, 0) FROM supplier)
"""
CURATION = """WITH raw AS (SELECT p_brand AS compound, ['Q91', 'Q63', 'P12', 'O75', 'Q965D'][p_partkey % 5 + 1] || lpad(CAST(p_partkey % 300 AS VARCHAR), 3, '0') AS protein_id, p_type AS source, p_partkey AS ord FROM part),
 mapping AS (SELECT protein_id, CASE WHEN g = 'MDR1' THEN 'ABCB1' ELSE g END AS gene FROM (SELECT protein_id, ['MDR1', 'GyrA', 'AKT1', 'insr', 'MMP2', 'NSP5', 'TNF'][min(ord) % 7 + 1] AS g FROM raw WHERE ord % 3 > 0 GROUP BY 1)),
 named AS (SELECT raw.*, gene, gene IS NOT NULL AND (regexp_matches(raw.protein_id, '^(Q91|Q9D|Q63|Q965D)') OR gene IN ('GyrA', 'NSP5') OR regexp_matches(gene, '^[a-z]')) AS alien FROM raw LEFT JOIN mapping ON raw.protein_id = mapping.protein_id)
"""


def _salts() -> str:
    out = "lower(trim(name))"
    for s in SALT_SUFFIXES:
        out = f"SELECT p_partkey, CASE WHEN ends_with(c, '{s}') THEN trim(c[: length(c) - {len(s)}]) ELSE c END AS c FROM ({out if out.startswith('SELECT') else f'SELECT p_partkey, {out} AS c FROM d'})"
    return f"WITH d AS (SELECT p_partkey, p_name || [' Hydrochloride', ' hcl sodium', '', ' sulfate dihydrate', ' dihydrate sulfate'][p_partkey % 5 + 1] AS name FROM part) SELECT p_partkey, c AS cleaned FROM ({out})"


SALTS = _salts()
PRINTS = """WITH t AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents),
 bits AS (SELECT DISTINCT doc_id, CAST('0x' || md5(w)[1:6] AS BIGINT) % 2048 AS b FROM t),
 size AS (SELECT doc_id, count(*) AS n FROM bits GROUP BY 1),
 refs AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'positive' ELSE 'negative' END AS category FROM documents WHERE doc_id % 3 < 2),
 common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM bits a JOIN bits b ON a.b = b.b WHERE a.doc_id < 2 GROUP BY 1, 2),
 scored AS (SELECT 'c' || s.doc_id AS compound, r.doc_id AS reference, r.category, coalesce(c.n, 0) / (s.n + z.n - coalesce(c.n, 0)) AS similarity
   FROM (SELECT * FROM size WHERE doc_id < 2) s CROSS JOIN refs r JOIN size z ON z.doc_id = r.doc_id LEFT JOIN common c ON c.x = s.doc_id AND c.y = r.doc_id)
"""
#: pairs: tests with ids divisible by 50 and references of a class that reach 0.4.
ANALOGS = PRINTS[: PRINTS.index(" common AS")] + """ common AS (SELECT a.doc_id AS compound, b.doc_id AS reference, count(*) AS n FROM bits a JOIN bits b ON a.b = b.b WHERE a.doc_id % 50 = 0 GROUP BY 1, 2),
 pairs AS (SELECT compound, reference, category, c.n / (x.n + y.n - c.n) AS similarity FROM common c JOIN size x ON x.doc_id = compound JOIN size y ON y.doc_id = reference JOIN refs r ON r.doc_id = reference WHERE c.n / (x.n + y.n - c.n) >= 0.4)
"""


def with_(select: str) -> str:
    return f"WITH {_BASE} {select}"


def _component_ctes(sym: str, nodes: str, tag: str = "") -> str:
    return f""", reach{tag}(node, root) AS (SELECT node, node FROM {nodes} UNION SELECT s.dst, r.root FROM reach{tag} r JOIN {sym} s ON s.src = r.node WHERE s.dst > r.root),
 comp{tag} AS (SELECT node, min(root) AS comp FROM reach{tag} GROUP BY 1),
 lcc{tag} AS (SELECT node FROM comp{tag} WHERE comp = (SELECT comp FROM comp{tag} GROUP BY 1 ORDER BY count(*) DESC, comp LIMIT 1))
"""


def components(keep: str | None = None) -> str:
    """comp and lcc of the strict graph (or of what keep induces), nodes2 the loose graph's largest component."""
    sym = "sym3" if keep is None else f"(SELECT src, dst FROM sym3 WHERE src IN {keep} AND dst IN {keep})"
    nodes = "nodes3" if keep is None else f"(SELECT node FROM nodes3 WHERE node IN {keep})"
    loose = ", reach2(node) AS (SELECT min(node) FROM nodes UNION SELECT s.dst FROM reach2 r JOIN sym s ON s.src = r.node), nodes2 AS (SELECT node FROM reach2)\n"
    return f"WITH RECURSIVE {_BASE}{_component_ctes(sym, nodes)}{loose}"


def components_loose() -> str:
    return f"WITH RECURSIVE {_BASE}{_component_ctes('sym', 'nodes')}"


def dist_cte(least: int) -> str:
    sym = "sym3" if least == 3 else "sym"
    return f""", bfs(node, d) AS (SELECT node, 0 FROM disease WHERE node IN (SELECT src FROM {sym}) UNION SELECT s.dst, b.d + 1 FROM bfs b JOIN {sym} s ON s.src = b.node WHERE b.d < 30),
 dist AS (SELECT node, min(d) AS dist FROM bfs GROUP BY 1)
"""


def bfs(least: int = 3) -> str:
    return f"WITH RECURSIVE {_BASE}{dist_cte(least)}"


_WEIGHT = """, nx AS (SELECT n.node, log2(coalesce(x, 0) + 1) AS v FROM nodes n LEFT JOIN ex ON n.node = ex.node),
 xe AS (SELECT node, greatest((v - lo) / (hi - lo), 0.01) AS e FROM nx, (SELECT min(v) AS lo, max(v) AS hi FROM nx))
"""
_PLAIN = "(SELECT src, dst, 1 / count(*) OVER (PARTITION BY src) AS w FROM sym)"
_WEIGHTED = "(SELECT src, dst, e / sum(e) OVER (PARTITION BY src) AS w FROM sym JOIN xe ON dst = node)"


_R = "(SELECT node, CASE WHEN node IN (SELECT node FROM seeds) THEN 1 / (SELECT count(*) FROM seeds) ELSE 0 END AS r FROM nodes)"


def walk(compound: str, weighted: bool = False, alpha: float = 0.15) -> str:
    """w, and p: the walk from a target set after the first step whose L1 change is under 1e-6, or the hundredth."""
    return f"""WITH RECURSIVE {_BASE}{_WEIGHT}, w AS MATERIALIZED {_WEIGHTED if weighted else _PLAIN},
 seeds AS (SELECT node FROM targets WHERE compound = '{compound}' AND node IN (SELECT node FROM nodes)),
 r AS MATERIALIZED {_R},
 steps(step, node, p, change) AS (SELECT 0, node, r, 1e9 FROM r UNION ALL
  SELECT step + 1, node, new, sum(abs(new - old)) OVER () FROM (SELECT s.step, r.node, s.p AS old, {1 - alpha} * coalesce(q, 0) + {alpha} * r.r AS new FROM steps s JOIN r ON s.node = r.node
    LEFT JOIN (SELECT dst AS node, sum(w * p) AS q FROM w JOIN steps ON src = node GROUP BY 1) y ON r.node = y.node WHERE s.change >= 1e-6 AND s.step < 100)),
 p AS MATERIALIZED (SELECT node, p FROM steps WHERE step = (SELECT max(step) FROM steps))
"""


#: Steps after which no walk changes by 1e-6: log(1e-6 / 2) / log(0.85), rounded up.
ADJOINT_STEPS = 90


def adjoint(weighted: bool = False, both: bool = False, steps: int = ADJOINT_STEPS) -> str:
    """h: influence by node after so many steps; with both, h plain and g weighted."""
    out = f"WITH RECURSIVE {_BASE}{_WEIGHT}, b AS MATERIALIZED (SELECT node, CASE WHEN node IN (SELECT node FROM disease) THEN 1 ELSE 0 END AS b FROM nodes)\n"
    for name, w in (("h", _PLAIN), ("g", _WEIGHTED)) if both else (("h", _WEIGHTED if weighted else _PLAIN),):
        out += f""", w{name} AS MATERIALIZED {w},
 {name}_(step, node, h) AS (SELECT 0, node, CAST(b AS DOUBLE) FROM b UNION ALL
  SELECT s.step + 1, b.node, 0.85 * coalesce(q, 0) + 0.15 * b FROM {name}_ s JOIN b ON s.node = b.node LEFT JOIN (SELECT src AS node, sum(w * h) AS q FROM w{name} JOIN {name}_ ON dst = node GROUP BY 1) y ON b.node = y.node WHERE s.step < {steps}),
 {name} AS MATERIALIZED (SELECT node, h FROM {name}_ WHERE step = {steps})
"""
    return out


def draws(iterations: int, seed: int) -> str:
    """boot: bootstrap draws from set B of set A's size."""
    return f""", pool AS (SELECT DISTINCT node FROM targets WHERE compound = 'B' AND node IN (SELECT node FROM nodes)),
 boot AS (SELECT iter, node FROM (SELECT iter, node, row_number() OVER (PARTITION BY iter ORDER BY md5('{seed}:' || iter || ':' || node)) AS rn FROM pool, (SELECT CAST(unnest(range(0, {iterations})) AS INTEGER) AS iter))
   WHERE rn <= (SELECT count(DISTINCT node) FROM targets WHERE compound = 'A' AND node IN (SELECT node FROM nodes)))
"""


#: low and high degree of a target's band by matcher, whether targets may be drawn, and whether a second choice may repeat a node.
_BANDS = {
    "M1": ("deg - greatest(1, CAST(trunc(deg * 0.25) AS BIGINT))", "deg + greatest(1, CAST(trunc(deg * 0.25) AS BIGINT))", False, False),
    "M2": ("CAST(trunc(deg * 0.75) AS BIGINT)", "CAST(trunc(deg * 1.25) AS BIGINT) + 1", True, True),
    "M3": ("CAST(trunc(deg * 0.75) AS BIGINT)", "CAST(trunc(deg * 1.25) AS BIGINT)", True, False),
}


def matched(tag: str, wanted: str, permutations: int, seed: int, mode: str, sym: str = "sym", among: str | None = None) -> str:
    """drawn{tag}: (perm_id, k, node), degree-matched draws for the target set wanted.  Needs WITH RECURSIVE.

    Nodes that may be drawn have places in order of degree and name.  A target's draw is the first of 24 hashed
    places of its band that the permutation has not used, else one of the free places by a further hash; where the
    band has none, the same over all places.
    """
    low, high, targets_too, again = _BANDS[mode]
    pool = [] if targets_too else [f"node NOT IN (SELECT node FROM {wanted})"]
    pool += [f"node IN {among}"] if among else []
    roll = lambda n: f"('0x' || substr(md5('{seed}:' || perm_id || ':' || k || ':' || {n}), 1, 16))::UBIGINT"

    def first(a: str, b: str, again: bool = False) -> str:
        tried = f"list_transform(range(0, 24), lambda n: CAST({a} + {roll('n')} % ({b} - {a}) AS BIGINT))"
        if again:
            return f"CASE WHEN {b} > {a} THEN {tried}[1] END"
        free = f"list_filter(range({a}, {b}), lambda x: NOT list_contains(used, x))"
        return f"CASE WHEN {b} > {a} THEN coalesce(list_filter({tried}, lambda x: NOT list_contains(used, x))[1], CASE WHEN len({free}) > 0 THEN {free}[CAST({roll(24)} % len({free}) AS BIGINT) + 1] END) END"

    return f""", deg{tag} AS MATERIALIZED (SELECT src AS node, count(*) AS deg FROM {sym} GROUP BY 1),
 asked{tag} AS MATERIALIZED (SELECT deg, row_number() OVER (ORDER BY node) - 1 AS k FROM deg{tag} WHERE node IN (SELECT node FROM {wanted})),
 pool{tag} AS MATERIALIZED (SELECT node, deg, row_number() OVER (ORDER BY deg, node) - 1 AS place FROM deg{tag} {'WHERE ' + ' AND '.join(pool) if pool else ''}),
 spans{tag} AS MATERIALIZED (SELECT k, (SELECT count(*) FROM pool{tag} p WHERE p.deg < low) AS a, (SELECT count(*) FROM pool{tag} p WHERE p.deg <= high) AS b, (SELECT count(*) FROM pool{tag}) AS total FROM (SELECT k, {low} AS low, {high} AS high FROM asked{tag})),
 tries{tag}(perm_id, last, used, pick) AS (SELECT CAST(range AS INTEGER), CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM range({permutations}) UNION ALL
  SELECT perm_id, k, CASE WHEN spot IS NULL THEN used ELSE list_append(used, spot) END, spot FROM (
   SELECT perm_id, k, used, coalesce({first('a', 'b')}, {first('0', 'total', again)}) AS spot FROM tries{tag} JOIN spans{tag} ON k = last + 1)),
 drawn{tag} AS MATERIALIZED (SELECT perm_id, CAST(last AS INTEGER) AS k, node FROM tries{tag} JOIN pool{tag} ON pick = place)
"""


_SCORED = """, scored AS (SELECT o.compound, observed, avg(value) AS null_mean, stddev_pop(value) AS null_std, CASE WHEN stddev_pop(value) > 0 THEN (observed - avg(value)) / stddev_pop(value) ELSE 0 END AS z_score,
   (count(*) FILTER (value {0} observed) + 1) / (count(value) + 1) AS p_value FROM obs o JOIN null_ USING (compound) GROUP BY 1, 2)
"""


def _sets() -> str:
    return "".join(f", set{c} AS (SELECT DISTINCT node FROM targets WHERE compound = '{c}')\n" for c in "AB")


def permutation(permutations: int, seed: int, weighted: bool = False) -> str:
    """fdr: observed influence of both sets against degree-matched draws (M1)."""
    return (
        adjoint(weighted)
        + _sets()
        + "".join(matched(c, f"set{c}", permutations, seed, "M1") for c in "AB")
        + ", null_ AS (SELECT compound, perm_id, avg(h) AS value FROM (SELECT 'A' AS compound, * FROM drawnA UNION ALL SELECT 'B', * FROM drawnB) JOIN h USING (node) GROUP BY 1, 2), obs AS (SELECT compound, avg(h) AS observed FROM targets JOIN h USING (node) GROUP BY 1)"
        + _SCORED.format(">=")
        + ", fdr AS (SELECT *, least(1, min(p_value * m / k) OVER (ORDER BY p_value DESC, k DESC ROWS UNBOUNDED PRECEDING)) AS p_fdr FROM (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS m FROM scored))\n"
    )


def path_permutation(permutations: int, seed: int) -> str:
    """scored: proximity of both sets against degree-matched draws (M2) in the strict graph."""
    return (
        bfs()
        + _sets()
        + "".join(matched(c, f"set{c}", permutations, seed, "M2", "sym3") for c in "AB")
        + ", null_ AS (SELECT compound, perm_id, avg(dist) AS value FROM (SELECT 'A' AS compound, * FROM drawnA UNION ALL SELECT 'B', * FROM drawnB) JOIN dist USING (node) GROUP BY 1, 2), obs AS (SELECT compound, avg(dist) AS observed FROM targets JOIN dist USING (node) GROUP BY 1)"
        + _SCORED.format("<=")
    )
