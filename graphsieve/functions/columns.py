"""Column-name resolution and scalar expressions of the curation steps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that edge and gene-set files use, in order of preference.
EDGE_COLUMNS = [("protein1", "protein2"), ("gene1", "gene2"), ("source", "target"), ("src", "dst")]
GENE_COLUMNS = ["protein_id", "gene_name", "gene_symbol"]

#: Alias to standard symbol.
ALIASES = {"MDR1": "ABCB1"}
#: Accession prefixes and symbols that are not human, and what they are.
NON_HUMAN_PREFIXES = ["Q91", "Q9D", "Q63", "Q965D"]
NON_HUMAN_GENES = ["GyrA", "HPV16E6", "NSP5", "NANA", "Insr", "Rrm2", "Ugt1a6", "Ugt1a7", "Ugt1a8", "Ugt1a9"]
SPECIES_PREFIXES = {"Mouse": ["Q91", "Q9D"], "Rat": ["Q63", "Q965D"]}
SPECIES_GENES = {"Bacterial": ["GyrA", "NANA"], "Viral": ["HPV16E6", "NSP5"]}
#: Suffixes of salts and hydrates, in the order in which they are stripped.
SALT_SUFFIXES = [
    " hydrochloride", " hcl", " sulfate", " sodium", " potassium", " calcium", " acetate", " maleate", " fumarate", " tartrate", " mesylate", " besylate",
    " phosphate", " citrate", " bromide", " chloride", " succinate", " lactate", " dihydrate", " monohydrate", " trihydrate", " dihydrochloride", " disodium", " dipotassium",
]
#: Cytokine and immune genes.
CYTOKINES = ["IL1A", "IL1B", "IL4", "IL6", "IL11", "IL17A", "IL22", "IFNA2", "IFNG", "TNF", "CSF3", "LTF"]
#: Severity categories of the similarity control.
POSITIVE_CATEGORIES = ["vmost-dili-concern", "vless-dili-concern"]
NEGATIVE_CATEGORIES = ["vno-dili-concern"]


def resolve_edges(df: DataFrame) -> DataFrame:
    """(src, dst, ...): the first known pair of endpoint names, else the first two columns; other columns stay."""
    a, b = next((p for p in EDGE_COLUMNS if set(p) <= set(df.columns)), tuple(df.columns[:2]))
    rest = [c for c in df.columns if c not in (a, b)]
    return df.select(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"), *rest)


def resolve_genes(df: DataFrame) -> DataFrame:
    """(node): distinct values of the first known gene column, else of the first column."""
    name = next((c for c in GENE_COLUMNS if c in df.columns), df.columns[0])
    return df.select(F.col(name).cast("string").alias("node")).dropna().distinct()


def standardise(symbol: Column) -> Column:
    return reduce(lambda e, kv: e.when(symbol == kv[0], F.lit(kv[1])), ALIASES.items(), F.when(F.lit(False), symbol)).otherwise(symbol)


def any_prefix(c: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def is_non_human(accession: Column, gene: Column) -> Column:
    """By accession prefix, by symbol, or by a symbol that begins in lower case; a null gene decides nothing."""
    return any_prefix(accession, NON_HUMAN_PREFIXES) | F.coalesce(gene.isin(NON_HUMAN_GENES) | gene.rlike(r"^\p{Ll}"), F.lit(False))


def species(accession: Column, gene: Column) -> Column:
    out = F.when(any_prefix(accession, SPECIES_PREFIXES["Mouse"]), "Mouse").when(any_prefix(accession, SPECIES_PREFIXES["Rat"]), "Rat")
    for name, genes in SPECIES_GENES.items():
        out = out.when(gene.isin(genes), name)
    return out.otherwise("Non-human")


def is_strict_accession(accession: Column) -> Column:
    return accession.rlike(r"^[PQO][0-9]{5}$")


def strip_salts(name: Column) -> Column:
    """Lower case without salt suffixes: each is tried once, in order, on what the ones before have left."""
    cut = lambda e, x: F.when(F.endswith(e, x), F.trim(F.left(e, F.length(e) - F.length(x)))).otherwise(e)
    return F.aggregate(F.array(*[F.lit(x) for x in SALT_SUFFIXES]), F.trim(F.lower(name)), cut)


def severity(category: Column) -> Column:
    """positive, negative, or null for ambiguous ones."""
    c = F.trim(F.lower(category))
    return F.when(c.isin(POSITIVE_CATEGORIES), "positive").when(c.isin(NEGATIVE_CATEGORIES), "negative")


def loss_category(gene: Column) -> Column:
    return F.when(gene.startswith("MIR"), "miRNA").when(gene.isin(CYTOKINES), "cytokine").otherwise("other")


def curation_reason(kept: Column, gene: Column, foreign: Column) -> Column:
    return F.when(kept, "KEPT").when(gene.isNull(), "No mapping").when(foreign, F.concat(F.lit("Non-human ("), gene, F.lit(")"))).otherwise("Unknown")


def component_reason(in_set: Column, expressed: Column, in_component: Column) -> Column:
    return F.when(in_set, "KEPT").when(~expressed, "Not expressed").when(~in_component, "Not in component").otherwise("Unknown")


def row_median(*cols: Column) -> Column:
    """Median of the non-null numbers of a row (null if there are none)."""
    v = F.array_sort(F.filter(F.array(*[c.try_cast("double") for c in cols]), lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(v)
    return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def ratio(x: Column, y: Column) -> Column:
    """x / y, infinite where y is not positive."""
    return F.when(y > 0, x / y).otherwise(F.lit(float("inf")))


def verdict(observed: Column, low: Column, high: Column) -> Column:
    return F.when(observed > high, "exceeds").when(observed < low, "below").otherwise("no difference")


def direction(weighted: Column, standard: Column) -> Column:
    return F.when(weighted > standard, "INCREASES").when(weighted < standard, "DECREASES").otherwise("minimal")
