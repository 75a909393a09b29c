"""Terminology services over a concept hierarchy: sets, mapping, common ancestors, families, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fts
from .closure import checkpointed, cyclic_parts, numbered, reachable, union_all
from .reach import Reach

# Hierarchies are (s, o): s has parent o. Sets are (s). ``below`` is the strict closure (s, o); what
# only asks which codes others imply takes an index of the hierarchy as well, which has no row for each pair.


def parents(edges: DataFrame, codes: DataFrame) -> DataFrame:
    return edges.join(codes, "s", "left_semi").select(F.col("o").alias("s")).distinct()


def children(edges: DataFrame, codes: DataFrame) -> DataFrame:
    return edges.join(codes.select(F.col("s").alias("o")), "o", "left_semi").select("s").distinct()


def ancestors(edges: DataFrame, codes: DataFrame, include_self: bool = True) -> DataFrame:
    return reachable(edges.select(F.col("o").alias("s"), F.col("s").alias("o")), codes, include_self)


def descendants(edges: DataFrame, codes: DataFrame, include_self: bool = True) -> DataFrame:
    return reachable(edges, codes, include_self)


def _reflexive(below: DataFrame, codes: DataFrame) -> DataFrame:
    return below.unionByName(codes.select("s", F.col("s").alias("o")))


def implied_by(below: DataFrame | Reach, codes: DataFrame, others: DataFrame) -> DataFrame:
    """(s): the codes that are, or are below, one of the others."""
    if isinstance(below, Reach):
        return below.implied_by(codes, others)
    return codes.join(_reflexive(below, codes).join(others.select(F.col("s").alias("o")), "o", "left_semi"), "s", "left_semi")


find = extract = implied_by


def subtract(below: DataFrame | Reach, codes: DataFrame, others: DataFrame) -> DataFrame:
    return codes.join(implied_by(below, codes, others), "s", "left_anti")


def is_semantic_subset(below: DataFrame | Reach, codes: DataFrame, others: DataFrame) -> bool:
    return subtract(below, codes, others).isEmpty()


def is_semantic_superset(below: DataFrame | Reach, codes: DataFrame, others: DataFrame) -> bool:
    return is_semantic_subset(below, others, codes)


def is_semantic_disjoint(below: DataFrame | Reach, codes: DataFrame, others: DataFrame) -> bool:
    return implied_by(below, codes, others).isEmpty() and implied_by(below, others, codes).isEmpty()


def semantic_intersection(below: DataFrame | Reach, codes: DataFrame, others: DataFrame) -> DataFrame:
    """(s): members of either set that are, or are below, a member of the other."""
    return implied_by(below, codes, others).unionByName(implied_by(below, others, codes)).distinct()


def compared(below: DataFrame | Reach, codes: DataFrame, others: DataFrame) -> DataFrame:
    """(op, s): ``implied``, ``subtract`` and ``common`` (``semantic_intersection``) of two sets, each read once and each tested once against the other."""
    codes, others = checkpointed(codes), checkpointed(others)
    there, back = checkpointed(implied_by(below, codes, others)), implied_by(below, others, codes)
    each = {"implied": there, "subtract": codes.join(there.hint("merge"), "s", "left_anti"), "common": there.unionByName(back).distinct()}
    return union_all([f.select(F.lit(k).alias("op"), "s") for k, f in each.items()])


def keep_most_specific(below: DataFrame, codes: DataFrame) -> DataFrame:
    upper = below.join(codes, "s", "left_semi").select(F.col("o").alias("s"))
    return codes.join(upper, "s", "left_anti")


def keep_most_generic(below: DataFrame, codes: DataFrame) -> DataFrame:
    lower = below.join(codes.select(F.col("s").alias("o")), "o", "left_semi").select("s")
    return codes.join(lower, "s", "left_anti")


def lowest_common_ancestors(edges: DataFrame, codes: list, kind: str = "bigint") -> DataFrame:
    """(s): concepts above (or among) all codes with no such concept beneath them."""
    spark = edges.sparkSession
    starts = spark.createDataFrame([(c, c) for c in dict.fromkeys(codes)], f"start {kind}, s {kind}")
    reached = frontier = checkpointed(starts)
    while True:
        step = frontier.join(edges, "s").select("start", F.col("o").alias("s")).distinct().join(reached, ["start", "s"], "left_anti")
        frontier = checkpointed(step)
        if frontier.isEmpty():
            break
        reached = checkpointed(reached.unionByName(frontier))
    common = checkpointed(reached.groupBy("s").agg(F.count_distinct("start").alias("n")).where(F.col("n") == len(set(codes))).select("s"))
    inside = edges.join(common, "s", "left_semi").join(common.select(F.col("s").alias("o")), "o", "left_semi")
    return keep_most_specific(inside, common)


def complete_families(edges: DataFrame, present: DataFrame, least: int = 1) -> DataFrame:
    """(parent): parents of which every child is present, with at least ``least`` children."""
    all_children = edges.groupBy("o").agg(F.count_distinct("s").alias("n"))
    have = edges.join(present, "s", "left_semi").groupBy("o").agg(F.count_distinct("s").alias("k"))
    return have.join(all_children, "o").where(f"n = k AND n >= {int(least)}").select(F.col("o").alias("parent"))


def remove_entire_families(edges: DataFrame, codes: DataFrame, least: int = 2) -> DataFrame:
    """(s): complete sibling sets replaced by their parent, again and again."""
    now = checkpointed(codes.select("s").distinct())
    while True:
        whole = checkpointed(complete_families(edges, now, least).join(now.select(F.col("s").alias("parent")), "parent", "left_anti"))
        if whole.isEmpty():
            return now
        under = edges.join(whole.select(F.col("parent").alias("o")), "o", "left_semi").select("s")
        now = checkpointed(now.join(under, "s", "left_anti").unionByName(whole.select(F.col("parent").alias("s"))).distinct())


def map_through(links: DataFrame, other: DataFrame) -> DataFrame:
    """(src, dst): members of two terminologies that share a concept; ``links`` and ``other`` are (code, concept)."""
    return links.select(F.col("code").alias("src"), "concept").join(other.select(F.col("code").alias("dst"), "concept"), "concept").select("src", "dst").distinct()


def map_concepts(codes: DataFrame, edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """(s, dst): each code's mapping, or else that of its nearest ancestors that have one; cycles are climbed once."""
    at = checkpointed(codes.select("s", F.col("s").alias("at")))
    seen, out = [at], []
    while not at.isEmpty():
        hit = checkpointed(at.join(mapping.select(F.col("src").alias("at"), "dst"), "at").select("s", "dst").distinct())
        out.append(hit)
        rest = at.join(hit.select("s"), "s", "left_anti")
        up = rest.join(edges.select(F.col("s").alias("at"), "o"), "at").select("s", F.col("o").alias("at")).distinct()
        at = checkpointed(up.join(union_all(seen), ["s", "at"], "left_anti"))
        seen.append(at)
    return union_all(out) if out else codes.select("s", F.col("s").alias("dst")).limit(0)


def plain_code(code, exceptions: dict[str, str] | None = None):
    """A three-character code stands for its ``.9`` form, but for what ``exceptions`` names."""
    out = F.when(F.length(code) == 3, F.concat(code, F.lit(".9"))).otherwise(code)
    for k, x in (exceptions or {}).items():
        out = F.when(code == k, x).otherwise(out)
    return out


def parent_votes(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("votes"))


def break_cycles(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (s, o), equivalences (s, o)) from (s, o, votes).

    In a cycle the child's best parent stays if it has twice the votes of the
    next; cycles that remain are merged: their members become equivalent to the
    least and share the parents outside.
    """
    edges = votes.select("s", "o").distinct()
    parts = lambda e: checkpointed(cyclic_parts(e))
    inside = lambda e, part: e.join(part.select(F.col("node").alias("s"), F.col("part").alias("ps")), "s").join(part.select(F.col("node").alias("o"), F.col("part").alias("po")), "o").where("ps = po")
    cyclic = inside(edges, parts(edges)).select("s", "o")
    ranked = votes.join(cyclic, ["s", "o"], "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("votes"), "o")))
    top = ranked.groupBy("s").agg(F.max(F.when(F.col("r") == 1, F.col("o"))).alias("best"), F.max(F.when(F.col("r") == 1, F.col("votes"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("votes"))).alias("b"))
    lost = ranked.join(top.where("b IS NOT NULL AND a >= 2 * b"), "s").where("o <> best").select("s", "o")
    kept = checkpointed(edges.join(lost, ["s", "o"], "left_anti"))
    group = parts(kept).select(F.col("node").alias("s"), F.col("part").alias("rep"))
    same = group.where("s <> rep").select("s", F.col("rep").alias("o"))
    merged = kept.join(group, "s", "left").select(F.coalesce("rep", "s").alias("s"), "o").join(group.select(F.col("s").alias("o"), F.col("rep").alias("orep")), "o", "left")
    return merged.select("s", F.coalesce("orep", "o").alias("o")).where("s <> o").distinct(), same


def concept(labels: DataFrame, terminology: str, code: str) -> DataFrame:
    """Rows of (terminology, code, label, synonyms) for one code."""
    return labels.where((F.col("terminology") == terminology) & (F.col("code") == code))


def full_code(terminology: str | Column, code: str | Column) -> Column:
    """The name of a concept over all terminologies: ``terminology/code``."""
    return F.concat_ws("/", terminology, code)


def terminology_roots(edges: DataFrame, terminology: str) -> DataFrame:
    """(s): full codes of a terminology that have no parent in it."""
    own = lambda c: F.startswith(F.col(c), F.lit(terminology + "/"))
    return edges.where(own("o")).select(F.col("o").alias("s")).distinct().join(edges.where(own("s") & own("o")).select("s"), "s", "left_anti")


def search_labels(labels: DataFrame, query: str, terminology: str | None = None) -> DataFrame:
    """(terminology, code, label) whose label or a synonym matches the full-text query."""
    rows = labels if terminology is None else labels.where(F.col("terminology") == terminology)
    texts = F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))
    return rows.where(F.exists(texts, lambda x: fts.matches(x, query))).select("terminology", "code", "label")


def ordered_by_code(codes: DataFrame) -> DataFrame:
    """(s, pos): codes in order, numbered from 1 within each terminology, what stands before the code's last ``/``.

    One order over range partitions gives the places, and a terminology's least
    place is taken from them, so neither a large terminology nor many fill one task.
    """
    group = F.regexp_replace("s", "/[^/]*$", "")
    placed = checkpointed(numbered(codes.select("s", group.alias("group")), "group", "s"))
    first = placed.groupBy("group").agg(F.min("pos").alias("first"))
    return placed.join(first, "group").select("s", (F.col("pos") - F.col("first") + 1).alias("pos"))


def by_generality(below: DataFrame, codes: DataFrame) -> DataFrame:
    """(s, n): codes with the number of concepts beneath them, the most general first when sorted by n."""
    counts = below.groupBy(F.col("o").alias("s")).agg(F.count("*").alias("n"))
    return codes.join(counts, "s", "left").select("s", F.coalesce("n", F.lit(0)).alias("n"))


def relation_groups(relations: DataFrame) -> DataFrame:
    """(s, grp, relations): a concept's relations (s, grp, kind, o) by group, as sorted (kind, o); group 0 is each relation by itself."""
    own = F.when(F.col("grp") == 0, F.concat_ws(" ", F.lit("0"), "kind", "o")).otherwise(F.col("grp").cast("string"))
    return relations.groupBy("s", own.alias("grp")).agg(F.array_sort(F.collect_set(F.struct("kind", "o"))).alias("relations"))
