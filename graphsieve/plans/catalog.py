"""Named queries over the star-schema tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import checks, diffusion, graph, paths, reshape, sampling, similarity, stats, tables
from ..operators.iterate import checkpointed, dealt
from . import derived as D
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED, DRAWS, PERMUTATIONS = 42, 100, 1000


def query(sql: str | None = None):
    """Registers a function under its name, and its SQL if it has some."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _edges(spark: SparkSession, sf: str, least: int = D.LOOSE) -> DataFrame:
    return graph.canonical(D.links(spark, sf).filter(F.col("score") >= least))


def _r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ---- edges, curation, relational steps


@query(S.with_("SELECT src, dst, score FROM e"))
def edge_extract(spark, sf):
    return _edges(spark, sf)


@query(S.with_("""SELECT least(m1.g, m2.g) AS src, greatest(m1.g, m2.g) AS dst, max(score) AS score FROM links
  JOIN (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS g FROM supplier) m1 ON links.src = m1.id
  JOIN (SELECT 'p' || p_partkey AS id, p_type || '-' || p_size AS g FROM part WHERE p_size > 3) m2 ON links.dst = m2.id
  WHERE score >= 2 AND m1.g <> m2.g GROUP BY 1, 2"""))
def edge_mapping(spark, sf):
    s = D.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("name"))
    p = D.table(spark, sf, "part").filter("p_size > 3").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat("p_type", F.lit("-"), "p_size").alias("name"))
    return graph.extract(D.links(spark, sf), s.unionAll(p), D.LOOSE)


def _raw(spark, sf):
    p = D.table(spark, sf, "part")
    accession = F.element_at(F.array(*[F.lit(x) for x in ("Q91", "Q63", "P12", "O75", "Q965D")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(F.col("p_brand").alias("compound"), F.concat(accession, F.lpad((F.col("p_partkey") % 300).cast("string"), 3, "0")).alias("protein_id"), F.col("p_type").alias("source"), F.col("p_partkey").alias("ord"))


def _mapping(spark, sf):
    # a third of the accessions have no gene; genes are symbols, aliases, foreign symbols and names in lower case
    gene = F.element_at(F.array(*[F.lit(x) for x in ("MDR1", "GyrA", "AKT1", "insr", "MMP2", "NSP5", "TNF")]), (F.col("ord") % 7 + 1).cast("int"))
    rows = _raw(spark, sf).filter("ord % 3 > 0").select("protein_id", gene.alias("gene_name"), "ord")
    return tables.keep_first(rows, ["protein_id"], [F.col("ord")]).drop("ord")


@query(S.CURATION + "SELECT compound, count(*) AS n_raw, count(*) FILTER (gene IS NULL) AS n_unmapped, count(*) FILTER (alien) AS n_foreign, count(*) FILTER (gene IS NOT NULL AND NOT alien) AS n_kept, count(*) FILTER (gene IS NOT NULL AND NOT alien) - count(DISTINCT protein_id) FILTER (gene IS NOT NULL AND NOT alien) AS n_duplicates FROM named GROUP BY 1")
def id_map_audit(spark, sf):
    return tables.curation_audit(_raw(spark, sf), _mapping(spark, sf))


@query(S.CURATION + "SELECT compound, protein_id, source, gene AS gene_name FROM (SELECT *, row_number() OVER (PARTITION BY compound, protein_id ORDER BY ord) AS rn FROM named WHERE gene IS NOT NULL AND NOT alien) WHERE rn = 1")
def curated_targets(spark, sf):
    return tables.curate(_raw(spark, sf), _mapping(spark, sf), [F.col("ord")])


@query(S.CURATION + """SELECT compound, CAST(row_number() OVER (PARTITION BY compound ORDER BY ord, protein_id) AS INTEGER) AS idx, protein_id, coalesce(gene, 'NO_MAPPING') AS gene,
  CASE WHEN gene IS NULL THEN 'No mapping' WHEN alien THEN 'Non-human (' || gene || ')' ELSE 'KEPT' END AS reason,
  CASE WHEN NOT alien THEN NULL WHEN protein_id LIKE 'Q91%' OR protein_id LIKE 'Q9D%' THEN 'Mouse' WHEN protein_id LIKE 'Q63%' OR protein_id LIKE 'Q965D%' THEN 'Rat'
       WHEN gene IN ('GyrA', 'NANA') THEN 'Bacterial' WHEN gene IN ('HPV16E6', 'NSP5') THEN 'Viral' ELSE 'Non-human' END AS species FROM named""")
def exclusion_trace(spark, sf):
    return tables.exclusion_trace(_raw(spark, sf), _mapping(spark, sf), "ord")


@query(S.CURATION + "SELECT compound, protein_id, ord FROM (SELECT compound, protein_id, ord, coalesce(gene, 'UNMAPPED_' || protein_id) AS g FROM named) WHERE NOT starts_with(g, 'UNMAPPED')")
def placeholder_filter(spark, sf):
    named = tables.map_ids(_raw(spark, sf), _mapping(spark, sf))
    return tables.placeholder(named).filter(~F.col("gene_name").startswith("UNMAPPED")).select("compound", "protein_id", "ord")


@query(S.CURATION + "SELECT protein_id, regexp_matches(protein_id, '^[PQO][0-9]{5}$') AS strict FROM (SELECT DISTINCT protein_id FROM raw)")
def accession_filter(spark, sf):
    return _raw(spark, sf).select("protein_id").distinct().select("protein_id", C.is_strict_accession(F.col("protein_id")).alias("strict"))


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def dedupe_keep_first(spark, sf):
    df = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return tables.keep_first(df, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).drop("l_linenumber")


@query("SELECT l_suppkey, l_partkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1, 2")
def dedupe_keep_best(spark, sf):
    return D.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("best"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1 ORDER BY o_totalprice DESC, o_custkey LIMIT 10")
def dedupe_then_top(spark, sf):
    df = D.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return tables.keep_first(df, ["o_custkey"], [F.col("o_orderkey")]).orderBy(F.desc("o_totalprice"), "o_custkey").limit(10)


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def last_value_wins(spark, sf):
    return tables.last_value(D.table(spark, sf, "events"), "user_id", "value", "event_id")


def _drug(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(x) for x in (" Hydrochloride", " hcl sodium", "", " sulfate dihydrate", " dihydrate sulfate")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return D.table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), F.initcap("p_name"), suffix).alias("name"))


@query(S.SALTS)
def suffix_clean(spark, sf):
    return _drug(spark, sf).select("p_partkey", C.strip_salts(F.col("name")).alias("cleaned"))


@query("SELECT c_mktsegment, lower(trim(' ' || c_mktsegment || '  ')) AS category, count(*) AS n FROM customer GROUP BY 1, 2")
def category_norm(spark, sf):
    return D.table(spark, sf, "customer").groupBy("c_mktsegment", F.lower(F.trim(F.concat(F.lit(" "), "c_mktsegment", F.lit("  ")))).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT CASE p_brand WHEN 'MDR1' THEN 'ABCB1' ELSE p_brand END AS gene, count(*) AS n FROM (SELECT CASE WHEN p_size = 1 THEN 'MDR1' ELSE p_brand END AS p_brand FROM part) GROUP BY 1")
def alias_standardise(spark, sf):
    p = D.table(spark, sf, "part").select(F.when(F.col("p_size") == 1, "MDR1").otherwise(F.col("p_brand")).alias("g"))
    return p.groupBy(C.standardise(F.col("g")).alias("gene")).agg(F.count("*").alias("n"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def value_counts(spark, sf):
    return tables.value_counts(D.table(spark, sf, "part"), "p_type")


@query("SELECT gene, CASE WHEN starts_with(gene, 'MIR') THEN 'miRNA' WHEN gene IN ('TNF', 'IL6') THEN 'cytokine' ELSE 'other' END AS category FROM (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'MIR' || p_size WHEN 1 THEN 'TNF' WHEN 2 THEN 'IL6' ELSE 'CYP' || p_size END AS gene FROM part)")
def loss_category(spark, sf):
    k = F.col("p_partkey") % 4
    gene = F.when(k == 0, F.concat(F.lit("MIR"), "p_size")).when(k == 1, "TNF").when(k == 2, "IL6").otherwise(F.concat(F.lit("CYP"), "p_size"))
    return D.table(spark, sf, "part").select(gene.alias("gene")).distinct().select("gene", C.loss_category(F.col("gene")).alias("category"))


# ---- expression


@query(S.with_("SELECT node, x FROM ex WHERE x >= 950"))
def expressed_nodes_ge(spark, sf):
    return D.expression(spark, sf).filter(F.col("x") >= 950)


@query(S.with_("SELECT node, x FROM ex WHERE x > 950"))
def expressed_nodes_gt(spark, sf):
    return D.expression(spark, sf).filter(F.col("x") > 950)


@query("SELECT l_orderkey, l_linenumber, round(list_sort([l_quantity, l_extendedprice / 1000, l_tax * 100])[2], 6) AS med FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax FROM lineitem)")
def row_median(spark, sf):
    df = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax").distinct()
    return df.select("l_orderkey", "l_linenumber", F.round(C.row_median(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_tax") * 100), 6).alias("med"))


def _norm_sql(method: str) -> str:
    x = "log2(coalesce(x, 0) + 1)" if method == "log_minmax" else "coalesce(x, 0)"
    return f"SELECT node, round(e, 6) AS e FROM (SELECT node, greatest(CASE WHEN max(v) OVER () > min(v) OVER () THEN (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) ELSE 1 END, 0.01) AS e FROM (SELECT n.node, {x} AS v FROM nodes n LEFT JOIN ex ON n.node = ex.node))"


@query(S.with_(_norm_sql("log_minmax")))
def expr_normalise(spark, sf):
    return diffusion.normalise(graph.nodes_of(_edges(spark, sf)), D.expression(spark, sf)).select("node", *_r6("e"))


@query(S.with_(_norm_sql("minmax")))
def expr_normalise_linear(spark, sf):
    return diffusion.normalise(graph.nodes_of(_edges(spark, sf)), D.expression(spark, sf), "minmax").select("node", *_r6("e"))


@query(S.with_("SELECT t.compound, round(avg(coalesce(x, 0)), 6) AS mean_all, round(avg(x), 6) AS mean_known FROM targets t LEFT JOIN (SELECT node, x FROM ex WHERE x > 930) ex ON t.node = ex.node GROUP BY 1"))
def mean_target_expression(spark, sf):
    j = D.targets(spark, sf).join(D.expression(spark, sf).filter("x > 930"), "node", "left")
    return j.groupBy("compound").agg(F.round(F.avg(F.coalesce("x", F.lit(0.0))), 6).alias("mean_all"), F.round(F.avg("x"), 6).alias("mean_known"))


# ---- graph


@query(S.with_("SELECT src AS node, count(*) AS degree FROM sym GROUP BY 1"))
def degree(spark, sf):
    return graph.degree(_edges(spark, sf))


@query(S.with_("SELECT degree, count(*) AS n FROM (SELECT src, count(*) AS degree FROM sym GROUP BY 1) GROUP BY 1"))
def degree_hist(spark, sf):
    return tables.value_counts(graph.degree(_edges(spark, sf)), "degree")


@query(S.with_("SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM e) AS n_edges"))
def graph_counts(spark, sf):
    return graph.counts(_edges(spark, sf))


_KEEP = "(SELECT node FROM ex WHERE x >= 950)"


def _keep(spark, sf):
    return D.expression(spark, sf).filter("x >= 950").select("node")


@query(S.with_(f"SELECT src, dst, score FROM e WHERE src IN {_KEEP} AND dst IN {_KEEP}"))
def induced_subgraph(spark, sf):
    return graph.induced(_edges(spark, sf), _keep(spark, sf))


@query(S.with_("SELECT t.compound, t.node, t.node IN (SELECT node FROM nodes) AS in_loose, t.node IN (SELECT node FROM nodes3) AS in_strict FROM targets t"))
def membership_flags(spark, sf):
    return tables.with_flags(D.targets(spark, sf), "node", in_loose=graph.nodes_of(_edges(spark, sf)), in_strict=graph.nodes_of(_edges(spark, sf, D.STRICT)))


@query(S.with_("SELECT node FROM nodes INTERSECT SELECT node FROM disease"))
def setops_overlap(spark, sf):
    return tables.in_both(graph.nodes_of(_edges(spark, sf)), D.disease(spark, sf))


@query(S.with_("SELECT node FROM disease EXCEPT SELECT node FROM nodes3"))
def setops_diff(spark, sf):
    return tables.only_in(D.disease(spark, sf), graph.nodes_of(_edges(spark, sf, D.STRICT)))


@query(S.with_("SELECT node FROM disease UNION SELECT node FROM targets"))
def setops_union(spark, sf):
    return D.disease(spark, sf).union(D.targets(spark, sf).select("node")).distinct()


@query(S.with_("SELECT x = 0 AS subset, x = 0 AND y > 0 AS strict, x = 0 AND y = 0 AS equal FROM (SELECT (SELECT count(*) FROM (SELECT node FROM nodes3 EXCEPT SELECT node FROM nodes)) AS x, (SELECT count(*) FROM (SELECT node FROM nodes EXCEPT SELECT node FROM nodes3)) AS y)"))
def setops_subset(spark, sf):
    return tables.is_subset(graph.nodes_of(_edges(spark, sf, D.STRICT)), graph.nodes_of(_edges(spark, sf)))


@query(S.components() + "SELECT node, comp FROM comp")
def components(spark, sf):
    return graph.components(_edges(spark, sf, D.STRICT))


@query(S.components_loose() + "SELECT node, comp FROM comp")
def components_loose(spark, sf):
    return graph.components(_edges(spark, sf))


@query(S.components() + "SELECT node, comp FROM comp")
def components_distributed(spark, sf):
    """By the DataFrame loop that large graphs take."""
    return graph.components(_edges(spark, sf, D.STRICT))


_MAPPED = "(SELECT 's' || s_suppkey AS node FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size > 3)"


@query(S.components(_MAPPED) + "SELECT upper(src) AS src, upper(dst) AS dst, score FROM e WHERE score >= 3 AND src IN (SELECT node FROM lcc) AND dst IN (SELECT node FROM lcc)")
def network_lcc(spark, sf):
    """From scored links straight to the mapped graph's largest component."""
    s = D.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("S"), "s_suppkey").alias("name"))
    p = D.table(spark, sf, "part").filter("p_size > 3").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("P"), "p_partkey").alias("name"))
    return graph.network(D.links(spark, sf), s.unionAll(p), D.STRICT)


@query(S.components() + "SELECT node FROM lcc")
def lcc(spark, sf):
    return graph.largest_component(_edges(spark, sf, D.STRICT))


@query(S.components(_KEEP) + "SELECT node FROM lcc")
def tissue_lcc(spark, sf):
    e = _edges(spark, sf, D.STRICT)
    return graph.filter_to(e, graph.nodes_of(e), _keep(spark, sf))


@query(S.components() + "SELECT count(*) AS n_nodes, count(DISTINCT comp) AS n_components, count(DISTINCT comp) = 1 AS connected FROM comp")
def validate_network(spark, sf):
    return graph.validate(_edges(spark, sf, D.STRICT))


@query(S.components() + "SELECT node FROM lcc INTERSECT SELECT node FROM nodes2")
def nested_lcc(spark, sf):
    return tables.in_both(graph.largest_component(_edges(spark, sf, D.STRICT)), graph.largest_component(_edges(spark, sf)))


@query(S.components() + """SELECT t.compound, t.node, CASE WHEN t.node IN (SELECT node FROM lcc) THEN 'KEPT' WHEN coalesce(ex.x, 0) < 950 THEN 'Not expressed' ELSE 'Not in component' END AS reason
  FROM targets t LEFT JOIN ex ON t.node = ex.node""")
def component_trace(spark, sf):
    inside = graph.largest_component(_edges(spark, sf, D.STRICT))
    f = tables.with_flags(D.targets(spark, sf), "node", inside=inside, expressed=_keep(spark, sf))
    return f.select("compound", "node", C.component_reason(F.col("inside"), F.col("expressed"), F.col("inside")).alias("reason"))


@query(S.bfs() + "SELECT node, dist FROM dist")
def bfs_distance(spark, sf):
    return paths.distances(_edges(spark, sf, D.STRICT), D.disease(spark, sf))


@query(S.bfs(2) + "SELECT node, dist FROM dist")
def bfs_distance_distributed(spark, sf):
    """The loose graph by the DataFrame loop that large graphs take."""
    return paths.distances(_edges(spark, sf), D.disease(spark, sf))


_PAIRS = """, hops(source, node, d) AS (SELECT node, node, 0 FROM disease WHERE node IN (SELECT src FROM sym3) UNION SELECT h.source, s.dst, h.d + 1 FROM hops h JOIN sym3 s ON s.src = h.node WHERE h.d < 200),
 pairs AS (SELECT node AS target, source, CAST(min(d) AS INTEGER) AS dist FROM hops WHERE node IN (SELECT node FROM targets) GROUP BY 1, 2)
"""


@query(S.components() + _PAIRS + "SELECT target, source, dist FROM pairs")
def pair_distances(spark, sf):
    """Every target by every disease node that reaches it, by searches of many sources at once."""
    return paths.pair_distances(_edges(spark, sf, D.STRICT), D.disease(spark, sf), D.targets(spark, sf))


@query(S.bfs() + "SELECT compound, round(avg(dist), 6) AS dc, count(dist) AS n_reached FROM targets t LEFT JOIN dist ON t.node = dist.node GROUP BY 1")
def proximity_by_pairs(spark, sf):
    """The mean of the targets' least pair distances: proximity_dc by another way."""
    least = pair_distances(spark, sf).groupBy(F.col("target").alias("node")).agg(F.min("dist").alias("dist"))
    return paths.proximity(least, D.targets(spark, sf), ["compound"]).select("compound", *_r6("dc"), "n_reached")


@query(S.bfs() + "SELECT compound, round(avg(dist), 6) AS dc, count(dist) AS n_reached FROM targets t LEFT JOIN dist ON t.node = dist.node GROUP BY 1")
def proximity_dc(spark, sf):
    dist = paths.distances(_edges(spark, sf, D.STRICT), D.disease(spark, sf))
    return paths.proximity(dist, D.targets(spark, sf), ["compound"]).select("compound", *_r6("dc"), "n_reached")


@query(S.with_("SELECT s1.src AS node, count(*) AS n_neighbours, count(d.node) AS n_disease, round(count(d.node) / count(*), 6) AS share FROM (SELECT DISTINCT src FROM sym) t JOIN sym s1 ON s1.src = t.src LEFT JOIN disease d ON s1.dst = d.node GROUP BY 1"))
def direct_neighbors(spark, sf):
    e = _edges(spark, sf)
    return graph.direct_neighbours(e, graph.nodes_of(e), D.disease(spark, sf)).select("node", "n_neighbours", "n_disease", *_r6("share"))


# ---- diffusion


@query(S.walk("A") + "SELECT src, dst, round(w, 9) AS w FROM w")
def transition_matrix(spark, sf):
    return diffusion.transition(_edges(spark, sf)).select("src", "dst", F.round("w", 9).alias("w"))


@query(S.walk("A", True) + "SELECT src, dst, round(w, 9) AS w FROM w")
def ewi_transition(spark, sf):
    e = _edges(spark, sf)
    return diffusion.transition(e, _weights(spark, sf, e)).select("src", "dst", F.round("w", 9).alias("w"))


@query(S.with_("SELECT a.src, a.dst, round(score / sum(score) OVER (PARTITION BY a.src), 9) AS w FROM (SELECT src, dst, score FROM e UNION ALL SELECT dst, src, score FROM e) a"))
def transition_by_score(spark, sf):
    """Edges that carry a weight."""
    return diffusion.transition(_edges(spark, sf).withColumnRenamed("score", "weight")).select("src", "dst", F.round("w", 9).alias("w"))


def _weights(spark, sf, e):
    return diffusion.normalise(graph.nodes_of(e), D.expression(spark, sf))


def _seeds(spark, sf, compound="A"):
    return D.targets(spark, sf).filter(F.col("compound") == compound).select("node")


@query(S.walk("A") + "SELECT node, round(p, 6) AS p FROM p")
def rwr_scores(spark, sf):
    return diffusion.rwr(_edges(spark, sf), _seeds(spark, sf)).select("node", *_r6("p"))


@query(S.walk("A", True) + "SELECT node, round(p, 6) AS p FROM p")
def ewi_scores(spark, sf):
    e = _edges(spark, sf)
    return diffusion.rwr(e, _seeds(spark, sf), weight=_weights(spark, sf, e)).select("node", *_r6("p"))


@query(S.adjoint() + "SELECT node, round(h, 6) AS h FROM h")
def rwr_adjoint(spark, sf):
    return diffusion.adjoint(_edges(spark, sf), D.disease(spark, sf)).select("node", *_r6("h"))


@query(S.walk("A", alpha=0.6) + "SELECT node, round(p, 6) AS p FROM p")
def rwr_distributed(spark, sf):
    """To the tolerance by the DataFrame loop that large graphs take."""
    return diffusion.rwr(_edges(spark, sf), _seeds(spark, sf), 0.6).select("node", *_r6("p"))


@query(S.adjoint(steps=8) + "SELECT node, round(h, 6) AS h FROM h")
def adjoint_distributed(spark, sf):
    return diffusion.adjoint(_edges(spark, sf), D.disease(spark, sf), steps=8).select("node", *_r6("h"))


def _h(spark, sf, weighted=False):
    """(node, h), computed once."""
    e = _edges(spark, sf)
    return checkpointed(diffusion.adjoint(e, D.disease(spark, sf), weight=_weights(spark, sf, e) if weighted else None))


@query(S.adjoint() + "SELECT compound, count(*) AS n_targets, round(avg(h), 6) AS influence FROM targets JOIN h USING (node) GROUP BY 1")
def influence(spark, sf):
    return diffusion.influence(_h(spark, sf), D.targets(spark, sf), ["compound"]).select("compound", "n_targets", *_r6("influence"))


@query(S.walk("A") + "SELECT round(coalesce(sum(p), 0), 6) AS influence FROM p JOIN disease USING (node)")
def influence_forward(spark, sf):
    return diffusion.influence_of(diffusion.rwr(_edges(spark, sf), _seeds(spark, sf)), D.disease(spark, sf)).select(*_r6("influence"))


@query(S.adjoint() + "SELECT round(CASE WHEN b > 0 THEN a / b ELSE 'inf'::DOUBLE END, 5) AS ratio FROM (SELECT avg(h) FILTER (compound = 'A') AS a, avg(h) FILTER (compound = 'B') AS b FROM targets JOIN h USING (node))")
def efficiency_ratio(spark, sf):
    i = reshape.wide(diffusion.influence(_h(spark, sf), D.targets(spark, sf), ["compound"]).withColumn("k", F.lit(1)), "k", "compound", ["A", "B"], "influence")
    return i.select(F.round(C.ratio(F.col("A"), F.col("B")), 5).alias("ratio"))


def _both(spark, sf):
    t = D.targets(spark, sf)
    a = diffusion.influence(_h(spark, sf), t, ["compound"]).withColumnRenamed("influence", "standard")
    b = diffusion.influence(_h(spark, sf, True), t, ["compound"]).select("compound", F.col("influence").alias("weighted"))
    return a.join(b, "compound")


@query(S.adjoint(both=True) + "SELECT compound, count(*) AS n_targets, round(avg(h.h), 6) AS standard, round(avg(g.h), 6) AS weighted, CASE WHEN avg(g.h) > avg(h.h) THEN 'INCREASES' WHEN avg(g.h) < avg(h.h) THEN 'DECREASES' ELSE 'minimal' END AS effect FROM targets JOIN h h USING (node) JOIN g g USING (node) GROUP BY 1")
def standard_vs_weighted(spark, sf):
    return _both(spark, sf).select("compound", "n_targets", *_r6("standard", "weighted"), C.direction(F.col("weighted"), F.col("standard")).alias("effect"))


# ---- sampling and statistics


@query(S.with_("SELECT t.node AS target, n.src AS node FROM (SELECT src AS node, count(*) AS k FROM sym GROUP BY 1) t JOIN (SELECT src, count(*) AS k FROM sym GROUP BY 1) n ON abs(n.k - t.k) <= greatest(1, floor(t.k * 0.25)) WHERE t.node IN (SELECT node FROM targets WHERE compound = 'A') AND n.src NOT IN (SELECT node FROM targets WHERE compound = 'A')"))
def degree_bands(spark, sf):
    return sampling.bands(graph.degree(_edges(spark, sf)), _seeds(spark, sf))


def _matched(mode: str, among: str | None = None) -> str:
    return S.with_(", setA AS (SELECT DISTINCT node FROM targets WHERE compound = 'A')" + S.matched("A", "setA", 20, SEED, mode, among=among) + "SELECT perm_id, k, node FROM drawnA").replace("WITH", "WITH RECURSIVE", 1)


@query(_matched("M1"))
def degree_matched_draws(spark, sf):
    return sampling.degree_matched(graph.degree(_edges(spark, sf)), _seeds(spark, sf), 20, SEED)


@query(_matched("M2"))
def degree_matched_any(spark, sf):
    return sampling.degree_matched(graph.degree(_edges(spark, sf)), _seeds(spark, sf), 20, SEED, mode="M2")


@query(_matched("M3", _KEEP))
def degree_matched_expressed(spark, sf):
    return sampling.degree_matched(graph.degree(_edges(spark, sf)), _seeds(spark, sf), 20, SEED, mode="M3", expressed=_keep(spark, sf))


def _pool(spark, sf, e, compound):
    return D.targets(spark, sf).filter(F.col("compound") == compound).join(graph.nodes_of(e), "node", "left_semi").select("node")


def _draws(spark, sf):
    e = _edges(spark, sf)
    return sampling.bootstrap(_pool(spark, sf, e, "B"), _pool(spark, sf, e, "A").count(), DRAWS, SEED)


@query(S.with_("") + S.draws(DRAWS, SEED) + "SELECT iter, node FROM boot")
def bootstrap_draws(spark, sf):
    return _draws(spark, sf)


@query(S.adjoint() + S.draws(DRAWS, SEED) + """SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.025), 6) AS ci_lower, round(quantile_cont(value, 0.975), 6) AS ci_upper,
  count(*) AS n_bootstrap, round(max(o), 6) AS observed, max(o) > quantile_cont(value, 0.975) AS exceeds_ci, round(max(o) / avg(value), 4) AS fold
  FROM (SELECT iter, avg(h) AS value FROM boot JOIN h USING (node) GROUP BY 1), (SELECT avg(h) AS o FROM targets JOIN h USING (node) WHERE compound = 'A')""")
def bootstrap_summary(spark, sf):
    h = _h(spark, sf)
    values = _draws(spark, sf).join(h, "node").groupBy("iter").agg(F.avg("h").alias("value"))
    observed = diffusion.influence(h, D.targets(spark, sf).filter("compound = 'A'"), ["compound"]).select(F.col("influence").alias("o"))
    out = stats.bootstrap_summary(values.crossJoin(F.broadcast(observed)), F.col("o"), [])
    return out.select(*_r6("mean", "std", "ci_lower", "ci_upper", "observed"), "n_bootstrap", "exceeds_ci", F.round("fold", 4).alias("fold"))


@query(S.adjoint(True) + S.draws(DRAWS, SEED) + "SELECT round(max(o), 6) AS observed, round(avg(value), 6) AS mean, round(CASE WHEN avg(value) > 0 THEN max(o) / avg(value) ELSE 'inf'::DOUBLE END, 4) AS ratio, count(*) AS n_bootstrap FROM (SELECT iter, avg(h) AS value FROM boot JOIN h USING (node) GROUP BY 1), (SELECT avg(h) AS o FROM targets JOIN h USING (node) WHERE compound = 'A')")
def ewi_bootstrap(spark, sf):
    h = _h(spark, sf, True)
    values = _draws(spark, sf).join(h, "node").groupBy("iter").agg(F.avg("h").alias("value"))
    observed = diffusion.influence(h, D.targets(spark, sf).filter("compound = 'A'"), ["compound"]).select(F.col("influence").alias("o"))
    out = values.crossJoin(F.broadcast(observed)).agg(F.max("o").alias("observed"), F.avg("value").alias("mean"), F.count("*").alias("n_bootstrap"))
    return out.select(*_r6("observed", "mean"), F.round(C.ratio(F.col("observed"), F.col("mean")), 4).alias("ratio"), "n_bootstrap")


@query(S.adjoint(steps=130) + S.draws(DRAWS, SEED) + "SELECT iter, round(avg(h), 6) AS influence FROM boot JOIN h USING (node) GROUP BY 1")
def influence_of_draws(spark, sf):
    """Forward walks from all draws in one loop; the statement takes the adjoint's way."""
    walked = diffusion.rwr_many(_edges(spark, sf), _draws(spark, sf), "iter", tol=1e-9, max_iter=200)
    hit = walked.join(D.disease(spark, sf).distinct(), "node", "left_semi").groupBy("iter").agg(F.sum("p").alias("influence"))
    return hit.select("iter", *_r6("influence"))


def _null(spark, sf, e, mode, value):
    """(compound, value): value of each permutation's degree-matched draws (perm_id, node) for each target set."""
    degrees = checkpointed(graph.degree(e))
    out = [value(sampling.degree_matched(degrees, _seeds(spark, sf, c), PERMUTATIONS, SEED, mode)).select(F.lit(c).alias("compound"), "value") for c in ("A", "B")]
    return out[0].unionAll(out[1])


def _null_influence(spark, sf, h):
    return _null(spark, sf, _edges(spark, sf), "M1", lambda draws: draws.join(h, "node").groupBy("perm_id").agg(F.avg("h").alias("value")))


@query(S.permutation(PERMUTATIONS, SEED) + "SELECT compound, round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(null_std, 6) AS null_std, round(z_score, 4) AS z_score, round(p_value, 6) AS p_value, round(p_fdr, 6) AS p_fdr, p_fdr < 0.05 AS significant FROM fdr")
def permutation_test(spark, sf):
    h = _h(spark, sf)
    observed = diffusion.influence(h, D.targets(spark, sf), ["compound"]).select("compound", F.col("influence").alias("observed"))
    out = stats.bh(stats.null_summary(_null_influence(spark, sf, h), observed, ["compound"]), [])
    return out.select("compound", *_r6("observed", "null_mean", "null_std"), F.round("z_score", 4).alias("z_score"), *_r6("p_value", "p_fdr"), (F.col("p_fdr") < 0.05).alias("significant"))


@query(S.permutation(PERMUTATIONS, SEED, True) + "SELECT compound, round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(null_std, 6) AS null_std, round(z_score, 4) AS z_score, round(p_value, 6) AS p_value FROM fdr")
def ewi_permutation_test(spark, sf):
    h = _h(spark, sf, True)
    observed = diffusion.influence(h, D.targets(spark, sf), ["compound"]).select("compound", F.col("influence").alias("observed"))
    out = stats.null_summary(_null_influence(spark, sf, h), observed, ["compound"])
    return out.select("compound", *_r6("observed", "null_mean", "null_std"), F.round("z_score", 4).alias("z_score"), *_r6("p_value"))


@query(S.path_permutation(PERMUTATIONS, SEED) + "SELECT compound, round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(null_std, 6) AS null_std, round(z_score, 4) AS z_score, round(p_value, 6) AS p_value FROM scored")
def path_permutation_test(spark, sf):
    e = _edges(spark, sf, D.STRICT)
    dist = checkpointed(paths.distances(e, D.disease(spark, sf)))
    observed = paths.proximity(dist, D.targets(spark, sf), ["compound"]).select("compound", F.col("dc").alias("observed"))
    null = _null(spark, sf, e, "M2", lambda draws: paths.proximity(dist, draws, ["perm_id"]).select(F.col("dc").alias("value")).filter("value is not null"))
    # a set of which nothing is reached, in the graph or in all its draws, has no test: no row, as in the statement
    out = stats.null_summary(null, observed.filter("observed is not null"), ["compound"], "one_less").filter("null_mean is not null")
    return out.select("compound", *_r6("observed", "null_mean", "null_std"), F.round("z_score", 4).alias("z_score"), *_r6("p_value"))


@query("SELECT c_nationkey, round(z, 6) AS z FROM (SELECT c_nationkey, CASE WHEN stddev_pop(c_acctbal) > 0 THEN (5000 - avg(c_acctbal)) / stddev_pop(c_acctbal) ELSE 0 END AS z FROM customer GROUP BY 1)")
def zscore(spark, sf):
    g = D.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("s"))
    return g.select("c_nationkey", F.round(stats.z_score(F.lit(5000.0), F.col("m"), F.col("s")), 6).alias("z"))


_P = "(count(*) FILTER (c_acctbal {0} 5000) + 1) / (count(*) + 1)"


@query(f"SELECT c_nationkey, round({_P.format('>=')}, 6) AS greater, round({_P.format('<=')}, 6) AS less, round(2 * least({_P.format('>=')}, {_P.format('<=')}), 6) AS two FROM customer GROUP BY 1")
def empirical_p(spark, sf):
    p = lambda tail: F.round(stats.empirical_p(F.lit(5000.0), F.col("c_acctbal"), tail), 6)
    return D.table(spark, sf, "customer").groupBy("c_nationkey").agg(p("one_greater").alias("greater"), p("one_less").alias("less"), p("two").alias("two"))


@query("""WITH p AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE (s_suppkey * 37 % 1009) / 1009 END AS p_value FROM supplier),
 r AS (SELECT *, coalesce(p_value, 1) AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(p_value, 1), s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS m FROM p)
 SELECT s_suppkey, s_nationkey, round(least(1, min(v * m / k) OVER (PARTITION BY s_nationkey ORDER BY v DESC, k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_fdr(spark, sf):
    p = F.when(F.col("s_suppkey") % 9 == 0, None).otherwise((F.col("s_suppkey") * 37 % 1009) / 1009)
    return stats.bh(D.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", p.alias("p_value")), ["s_nationkey"], out="q").select("s_suppkey", "s_nationkey", *_r6("q"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE (l_orderkey * 37 + l_linenumber * 11 + l_partkey) % 100003 / 100003 END AS p_value FROM lineitem),
 r AS (SELECT *, coalesce(p_value, 1) AS v, row_number() OVER (ORDER BY coalesce(p_value, 1)) AS k, count(*) OVER () AS m FROM p)
 SELECT l_orderkey, l_linenumber, l_partkey, round(least(1, min(v * m / k) OVER (ORDER BY v DESC, k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_one_family(spark, sf):
    """All lines as one family."""
    li = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = F.when(F.col("l_partkey") % 97 == 0, None).otherwise((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11 + F.col("l_partkey")) % 100003 / 100003)
    return stats.bh(li.withColumn("p_value", p), [], out="q").select("l_orderkey", "l_linenumber", "l_partkey", *_r6("q"))


@query("SELECT l_returnflag, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.025), 4) AS low, round(quantile_cont(l_extendedprice, 0.5), 4) AS mid, round(quantile_cont(l_extendedprice, 0.975), 4) AS high FROM lineitem GROUP BY 1")
def exact_quantiles(spark, sf):
    q = stats.quantiles(D.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.025, 0.5, 0.975])
    return q.select("l_returnflag", "n", *(F.round(c, 4).alias(name) for c, name in (("q0", "low"), ("q1", "mid"), ("q2", "high"))))


@query("""WITH w AS (SELECT *, 0.9 * least(s, (q1 - q0) / 1.34) * pow(n, -0.2) AS h FROM (SELECT count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, stddev_samp(c_acctbal) AS s, quantile_cont(c_acctbal, 0.25) AS q0, quantile_cont(c_acctbal, 0.75) AS q1 FROM customer)),
 g AS (SELECT n, h, low - 3 * h AS start, (high - low + 6 * h) / 127 AS step FROM w), a AS (SELECT (c_acctbal - start) / step AS pos, floor((c_acctbal - start) / step) AS i FROM customer, g),
 b AS (SELECT i, sum(c) AS c FROM (SELECT i, 1 - (pos - i) AS c FROM a UNION ALL SELECT i + 1, pos - i FROM a) GROUP BY 1)
 SELECT j AS point, round(start + j * step, 4) AS x, round(10000 * sum(CASE WHEN abs((j - i) * step / h) <= 4 THEN c * exp(-pow((j - i) * step / h, 2) / 2) / sqrt(2 * pi()) / (n * h) ELSE 0 END), 5) AS density
 FROM b, g, (SELECT unnest(range(0, 128)) AS j) WHERE abs(j - i) <= ceil(4 * h / step) GROUP BY j, start, step""")
def kernel_density(spark, sf):
    d = stats.density(D.table(spark, sf, "customer"), "c_acctbal", 128)
    return tables.numbered(d, "x", "point").select("point", F.round("x", 4).alias("x"), F.round(10000 * F.col("density"), 5).alias("density"))


_PHI = "(SELECT 0.5 - list_sum(list_transform(range(0, 80), lambda k: pow(-1, k) * pow({z}, 2 * k + 1) / (pow(2, k) * gamma(k + 1) * (2 * k + 1)))) / sqrt(2 * pi()))"


@query(f"SELECT c_nationkey, round(2 * {_PHI.format(z='abs(z)')}, 6) AS two, round({_PHI.format(z='z')}, 6) AS one FROM (SELECT c_nationkey, round(CASE WHEN stddev_pop(c_acctbal) > 0 THEN (5000 - avg(c_acctbal)) / stddev_pop(c_acctbal) ELSE 0 END, 6) AS z FROM customer GROUP BY 1)")
def gaussian_p(spark, sf):
    z = zscore(spark, sf)
    return z.select("c_nationkey", F.round(stats.gaussian_p(F.col("z")), 6).alias("two"), F.round(stats.gaussian_p(F.col("z"), "one"), 6).alias("one"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total, CASE WHEN sum(o_totalprice) > 900000 THEN 'exceeds' WHEN sum(o_totalprice) < 300000 THEN 'below' ELSE 'no difference' END AS verdict FROM orders GROUP BY 1")
def conclusion(spark, sf):
    s = D.table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    return s.select("o_custkey", F.round("s", 2).alias("total"), C.verdict(F.col("s"), F.lit(300000), F.lit(900000)).alias("verdict"))


@query("SELECT width_bucket AS bin, count(*) AS n FROM (SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 10000 THEN 21 ELSE 1 + CAST(floor(c_acctbal / 500) AS BIGINT) END AS width_bucket FROM customer) GROUP BY 1")
def histogram(spark, sf):
    return reshape.histogram(D.table(spark, sf, "customer"), "c_acctbal", 0.0, 10000.0, 20)


# ---- similarity


def _tokens(c):
    return F.array_distinct(F.split(F.lower(c), " "))


def _prints(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "source", similarity.fold(_tokens(F.col("text"))).alias("bits"))
    tests = d.filter("doc_id < 2").select(F.concat(F.lit("c"), "doc_id").alias("compound"), "bits")
    kind = F.element_at(F.array(F.lit("vMost-DILI-concern "), F.lit(" vno-dili-concern"), F.lit("Ambiguous-DILI-concern")), (F.col("doc_id") % 3 + 1).cast("int"))
    refs = d.select(F.col("doc_id").alias("reference"), C.severity(kind).alias("category"), "bits").filter("category is not null")
    return tests, refs


@query(S.PRINTS + "SELECT compound, reference, category, round(similarity, 6) AS similarity FROM scored")
def tanimoto_pairs(spark, sf):
    return similarity.pairs(*_prints(spark, sf)).select("compound", "reference", "category", *_r6("similarity"))


@query(S.PRINTS + """SELECT compound, count(*) FILTER (category = 'positive') AS n_positive, round(avg(similarity) FILTER (category = 'positive'), 6) AS mean_positive, round(max(similarity) FILTER (category = 'positive'), 6) AS max_positive, round(stddev_pop(similarity) FILTER (category = 'positive'), 6) AS std_positive,
  count(*) FILTER (category = 'negative') AS n_negative, round(avg(similarity) FILTER (category = 'negative'), 6) AS mean_negative, round(max(similarity) FILTER (category = 'negative'), 6) AS max_negative, round(stddev_pop(similarity) FILTER (category = 'negative'), 6) AS std_negative,
  coalesce(max(similarity) FILTER (category = 'positive') >= 0.4, false) AS analog FROM scored GROUP BY 1""")
def tanimoto_summary(spark, sf):
    s = similarity.summary(similarity.pairs(*_prints(spark, sf)))
    return s.select("compound", "n_positive", *_r6("mean_positive", "max_positive", "std_positive"), "n_negative", *_r6("mean_negative", "max_negative", "std_negative"), "analog")


def _searched(spark, sf):
    """Documents with ids divisible by 50 as tests, the classed documents as references."""
    d = D.table(spark, sf, "documents").select("doc_id", similarity.fold(_tokens(F.col("text"))).alias("bits"))
    return d.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("compound"), "bits"), _prints(spark, sf)[1]


@query(S.ANALOGS + "SELECT compound, reference, category, round(similarity, 6) AS similarity FROM pairs WHERE compound <> reference")
def tanimoto_analogs(spark, sf):
    found = similarity.analogs(*_searched(spark, sf)).filter("compound <> reference")
    return found.select("compound", "reference", "category", *_r6("similarity"))


@query(S.ANALOGS + """SELECT t.doc_id AS compound, count(reference) FILTER (category = 'positive') AS n_positive, count(reference) FILTER (category = 'negative') AS n_negative,
  round(max(similarity) FILTER (category = 'positive'), 6) AS max_positive, count(reference) FILTER (category = 'positive') > 0 AS analog
  FROM (SELECT doc_id FROM documents WHERE doc_id % 50 = 0) t LEFT JOIN pairs ON compound = t.doc_id AND compound <> reference GROUP BY 1""")
def tanimoto_analog_flags(spark, sf):
    tests, refs = _searched(spark, sf)
    found = similarity.analogs(tests, refs).filter("compound <> reference")
    kind = lambda k: F.col("category") == k
    best = found.groupBy("compound").agg(F.count(F.when(kind("positive"), 1)).alias("p"), F.count(F.when(kind("negative"), 1)).alias("n"), F.max(F.when(kind("positive"), F.col("similarity"))).alias("max_positive"))
    some = lambda c: F.coalesce(c, F.lit(0))
    return tests.select("compound").join(best, "compound", "left").select("compound", some("p").alias("n_positive"), some("n").alias("n_negative"), *_r6("max_positive"), (some("p") > 0).alias("analog"))


@query("SELECT doc_id, CASE lower(trim(k)) WHEN 'vmost-dili-concern' THEN 'positive' WHEN 'vno-dili-concern' THEN 'negative' END AS category FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'vMost-DILI-concern ' WHEN 1 THEN ' vno-dili-concern' ELSE 'Ambiguous-DILI-concern' END AS k FROM documents)")
def severity_classes(spark, sf):
    kind = F.element_at(F.array(F.lit("vMost-DILI-concern "), F.lit(" vno-dili-concern"), F.lit("Ambiguous-DILI-concern")), (F.col("doc_id") % 3 + 1).cast("int"))
    return D.table(spark, sf, "documents").select("doc_id", C.severity(kind).alias("category"))


@query("SELECT p_partkey AS reference, p_type AS category, p_name AS smiles FROM part WHERE p_partkey % 4 IN (1, 2)")
def reference_resolution(spark, sf):
    p = D.table(spark, sf, "part")
    known = p.filter("p_partkey % 4 > 0").select(F.col("p_partkey").alias("name"), F.when(F.col("p_partkey") % 4 == 3, "").otherwise(F.col("p_name")).alias("smiles"))
    return similarity.resolve(p.select(F.col("p_partkey").alias("reference"), F.col("p_type").alias("category")), known)


@query("SELECT 'positive' AS category, p_partkey AS reference FROM part WHERE p_size < 3 UNION ALL SELECT 'negative', p_partkey FROM part WHERE p_size > 48")
def reference_export(spark, sf):
    p = D.table(spark, sf, "part")
    side = lambda name, cond: p.filter(cond).select(F.lit(name).alias("category"), F.col("p_partkey").alias("reference"))
    return side("positive", "p_size < 3").unionByName(side("negative", "p_size > 48"))


# ---- reports


@query("SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS O, sum(l_quantity) FILTER (l_linestatus = 'F') AS F FROM lineitem GROUP BY 1")
def pivot_wide(spark, sf):
    g = D.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    return reshape.wide(g, "l_returnflag", "l_linestatus", ["O", "F"], "q")


@query("SELECT p_type, 'low' AS reference, min(p_retailprice) AS value FROM part GROUP BY 1 UNION ALL SELECT p_type, 'high', max(p_retailprice) FROM part GROUP BY 1")
def unpivot_long(spark, sf):
    g = D.table(spark, sf, "part").groupBy("p_type").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    return reshape.long(g, ["p_type"], ["low", "high"], "reference", "value")


_FALL = "SELECT avg(s_acctbal) FILTER (s_nationkey < 5) AS ap, avg(s_acctbal) FILTER (s_nationkey >= 5 AND s_nationkey < 10) AS bp, avg(s_acctbal) FILTER (s_nationkey >= 10 AND s_nationkey < 15) AS aw, avg(s_acctbal) FILTER (s_nationkey >= 15) AS bw FROM supplier"


@query(f"""WITH z AS ({_FALL}), r AS (
 SELECT 1 AS ord, 'plain advantage' AS step, ap - bp AS value, 'total' AS kind, 0 AS ymin, ap - bp AS ymax FROM z UNION ALL
 SELECT 2, 'A change', aw - ap, 'change', ap - bp + aw - ap, ap - bp FROM z UNION ALL
 SELECT 3, 'B change', bw - bp, 'change', ap - bp + aw - ap, ap - bp + aw - ap + bw - bp FROM z UNION ALL
 SELECT 4, 'weighted advantage', aw - bw, 'total', 0, aw - bw FROM z)
 SELECT ord, step, kind, round(value, 4) AS value, round(ymin, 4) AS ymin, round(ymax, 4) AS ymax, CASE WHEN kind = 'total' THEN 'Total' WHEN value < 0 THEN 'Decrease' ELSE 'Increase' END AS fill, round((ymin + ymax) / 2, 4) AS label_y FROM r""")
def waterfall(spark, sf):
    s, n = D.table(spark, sf, "supplier"), F.col("s_nationkey")
    avg = lambda c, name: F.avg(F.when(c, F.col("s_acctbal"))).alias(name)
    row = s.agg(avg(n < 5, "a_plain"), avg((n >= 5) & (n < 10), "b_plain"), avg((n >= 10) & (n < 15), "a_weighted"), avg(n >= 15, "b_weighted"))
    return reshape.waterfall(row).select("ord", "step", "kind", *[F.round(c, 4).alias(c) for c in ("value", "ymin", "ymax")], "fill", F.round("label_y", 4).alias("label_y"))


@query("SELECT m.r_name AS method, l.v / 100 AS level, CAST(x AS INTEGER) AS x FROM region m, (SELECT unnest([5, 10, 15]) AS v) l, (SELECT unnest(range(0, 71)) AS x)")
def grid_unnest(spark, sf):
    levels = spark.createDataFrame([(5,), (10,), (15,)], "v int").select((F.col("v") / 100).alias("level"))
    return reshape.grid(levels, D.table(spark, sf, "region").select(F.col("r_name").alias("method")), 70)


@query("SELECT DISTINCT m.r_name AS method, l.v / 100 AS level, 70 AS x FROM region m, (SELECT unnest([5, 10, 15]) AS v) l")
def grid_labels(spark, sf):
    g = grid_unnest(spark, sf)
    return g.join(F.broadcast(g.agg(F.max("x").alias("x"))), "x", "left_semi").select("method", "level", "x").distinct()


@query(S.adjoint(both=True) + S.dist_cte(2) + "SELECT compound, n_targets, round(standard, 6) AS standard, round(weighted, 6) AS weighted, round(dc, 6) AS dc FROM (SELECT compound, count(*) AS n_targets, avg(h.h) AS standard, avg(g.h) AS weighted FROM targets JOIN h h USING (node) JOIN g g USING (node) GROUP BY 1) JOIN (SELECT compound, avg(dist) AS dc FROM targets JOIN dist USING (node) GROUP BY 1) USING (compound)")
def master_summary(spark, sf):
    dc = paths.proximity(paths.distances(_edges(spark, sf), D.disease(spark, sf)), D.targets(spark, sf), ["compound"]).select("compound", "dc")
    return _both(spark, sf).join(dc, "compound").select("compound", "n_targets", *_r6("standard", "weighted", "dc"))


@query(S.adjoint(both=True) + S.dist_cte(2) + """SELECT compound, 'influence' AS metric, count(*) AS n_targets, round(avg(h), 6) AS observed FROM targets JOIN h USING (node) GROUP BY 1
  UNION ALL SELECT compound, 'weighted', count(*), round(avg(h), 6) FROM targets JOIN g USING (node) GROUP BY 1
  UNION ALL SELECT compound, 'proximity', NULL, round(avg(dist), 6) FROM targets JOIN dist USING (node) GROUP BY 1""")
def consolidated(spark, sf):
    both = checkpointed(_both(spark, sf))
    parts = [both.select("compound", F.lit(m).alias("metric"), "n_targets", F.round(c, 6).alias("observed")) for m, c in (("influence", "standard"), ("weighted", "weighted"))]
    dc = paths.proximity(paths.distances(_edges(spark, sf), D.disease(spark, sf)), D.targets(spark, sf), ["compound"])
    return parts[0].unionByName(parts[1]).unionByName(dc.select("compound", F.lit("proximity").alias("metric"), F.round("dc", 6).alias("observed")), allowMissingColumns=True)


@query(S.with_("SELECT node, x FROM ex ORDER BY x DESC, node LIMIT 10"))
def topk(spark, sf):
    return D.expression(spark, sf).orderBy(F.desc("x"), "node").limit(10)


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN 1e-16 ELSE p_size / 100 END AS p_floor, round(p_retailprice / 7, 2) AS price FROM part")
def value_guards(spark, sf):
    p = F.when(F.col("p_size") == 1, 0.0).otherwise(F.col("p_size") / 100)
    return D.table(spark, sf, "part").select("p_partkey", F.when(p == 0, 1e-16).otherwise(p).alias("p_floor"), F.round(F.col("p_retailprice") / 7, 2).alias("price"))


@query(S.with_("""SELECT 'loose edges' AS "check", 'error' AS severity, CAST(x AS VARCHAR) AS expected, CAST(y AS VARCHAR) AS actual, x = y AS ok FROM (SELECT (SELECT count(*) FROM links WHERE score >= 2) AS x, (SELECT count(*) FROM e) AS y)
  UNION ALL SELECT 'ends', 'error', CAST(x AS VARCHAR), CAST(y AS VARCHAR), x = y FROM (SELECT (SELECT 2 * count(*) FROM links WHERE score >= 2) AS x, (SELECT sum(d)::BIGINT FROM (SELECT count(*) AS d FROM sym GROUP BY src)) AS y)
  UNION ALL SELECT 'strict in loose', 'error', 'true', CAST((SELECT count(*) = 0 FROM (SELECT node FROM nodes3 EXCEPT SELECT node FROM nodes)) AS VARCHAR), (SELECT count(*) = 0 FROM (SELECT node FROM nodes3 EXCEPT SELECT node FROM nodes))
  UNION ALL SELECT 'loops', 'error', '0', CAST((SELECT count(*) FROM e WHERE src = dst) AS VARCHAR), (SELECT count(*) = 0 FROM e WHERE src = dst)
  UNION ALL SELECT 'regions', 'warning', '6', CAST((SELECT count(*) FROM region) AS VARCHAR), (SELECT count(*) = 6 FROM region)"""))
def integrity_checks(spark, sf):
    """Of the graph of both thresholds; links are read once, and the checks of an edge's ends are one aggregate."""
    at = lambda least: F.col("score") >= least
    ends = F.array(F.struct(F.least("src", "dst").alias("node"), F.lit(1).alias("first")), F.struct(F.greatest("src", "dst").alias("node"), F.lit(0).alias("first")))
    ordered = D.links(spark, sf).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "score")
    pairs = dealt(ordered, D.n_lines(spark, sf), "src", "dst").groupBy("src", "dst").agg(F.count(F.when(at(D.LOOSE), 1)).alias("rows"), F.max("score").alias("score"))
    ended = pairs.select("rows", "score", (F.col("src") == F.col("dst")).alias("loop"), F.inline(ends))
    whole = ended.groupBy("node").agg(
        F.count(F.when(at(D.LOOSE), 1)).alias("degree"), F.count(F.when(at(D.STRICT), 1)).alias("strict"),
        F.sum(F.col("first") * F.col("rows")).alias("rows"), F.count(F.when(at(D.LOOSE) & (F.col("first") == 1), 1)).alias("edges"), F.count(F.when(at(D.LOOSE) & F.col("loop") & (F.col("first") == 1), 1)).alias("loops"),
    )
    found = checks.measured(whole, [
        checks.Measure("loose edges", F.sum("edges"), F.sum("rows")), checks.Measure("ends", F.sum("degree"), 2 * F.sum("rows")),
        checks.Measure("strict in loose", F.count(F.when(F.expr("strict > 0 and degree = 0"), 1)) == 0, True), checks.Measure("loops", F.sum("loops"), 0),
    ])
    return found.unionAll(checks.measured(D.table(spark, sf, "region"), [checks.Measure("regions", F.count("*"), 6, "warning")]))


@query(S.CURATION + """, counted AS (SELECT compound, count(*) AS n_raw, count(*) FILTER (gene IS NULL) AS n_unmapped, count(*) FILTER (alien) AS n_foreign, count(*) FILTER (gene IS NOT NULL AND NOT alien) AS n_kept,
  count(*) FILTER (gene IS NOT NULL AND NOT alien) - count(DISTINCT protein_id) FILTER (gene IS NOT NULL AND NOT alien) AS n_duplicates FROM named GROUP BY 1),
 ends AS (SELECT 'p' || l_partkey AS node, max(score) AS score FROM (SELECT l_partkey, l_suppkey, count(*) AS score FROM lineitem GROUP BY 1, 2) GROUP BY 1),
 met AS (SELECT p_brand AS compound, count(*) AS n_targets, count(*) FILTER (score >= 2) AS n_in_network, count(*) FILTER (score >= 3) AS n_in_strict FROM part LEFT JOIN ends ON node = 'p' || p_partkey GROUP BY 1),
 spec AS (SELECT compound, count(*) FILTER (gene IS NULL) AS no_mapping, count(*) FILTER (coalesce(alien, false)) AS non_human, count(*) FILTER (gene IS NOT NULL AND NOT alien) AS kept FROM named GROUP BY 1)
 SELECT 'curation' AS section, compound, measure, value FROM (UNPIVOT counted ON n_raw, n_unmapped, n_foreign, n_kept, n_duplicates INTO NAME measure VALUE value)
 UNION ALL SELECT 'exclusion', compound, measure, value FROM (UNPIVOT spec ON no_mapping, non_human, kept INTO NAME measure VALUE value)
 UNION ALL SELECT 'network', compound, measure, value FROM (UNPIVOT met ON n_targets, n_in_network, n_in_strict INTO NAME measure VALUE value)""")
def trace_report(spark, sf):
    """The sections of the traceability report: what curation counts, why rows went, which targets the networks hold."""
    raw, mapping = _raw(spark, sf), _mapping(spark, sf)
    why = tables.exclusion_trace(raw, mapping, "ord").groupBy("compound").agg(
        F.count(F.when(F.col("reason") == "No mapping", 1)).alias("no_mapping"), F.count(F.when(F.col("reason").startswith("Non-human"), 1)).alias("non_human"), F.count(F.when(F.col("reason") == "KEPT", 1)).alias("kept"),
    )
    best = D.links(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.max("score").alias("score"))
    goal = D.table(spark, sf, "part").select(F.col("p_brand").alias("compound"), D.part_node().alias("node")).join(best, "node", "left")
    at = lambda least, name: F.count(F.when(F.col("score") >= least, 1)).alias(name)
    met = goal.groupBy("compound").agg(F.count("*").alias("n_targets"), at(D.LOOSE, "n_in_network"), at(D.STRICT, "n_in_strict"))
    return reshape.trace({"curation": tables.curation_audit(raw, mapping), "exclusion": why, "network": met}, "compound")
