"""Greedy seed grouping as a parallel fixpoint.

The reference walks records newest first; an unclaimed record becomes a seed and
claims every later unclaimed record similar to it.  On the graph of similarity edges
``(u, v)`` (u earlier) that is the lexicographically-first maximal independent set:

* v is a seed  iff  none of its earlier neighbours is a seed;
* a non-seed belongs to its earliest seed neighbour.

A round decides, in parallel, every undecided vertex whose status already follows from
decided neighbours: one with a seed neighbour is a member; one whose earlier neighbours
are all members (or that has none) is a seed.  On random orders O(log^2 n) rounds settle
everything (Blelloch, Fineman, Shun 2012), but a chain of n records needs n / 2 of them.  So
a few rounds run on one plan and are written; the edges between vertices that are still
open then fall into components, and each component of at most ``COMPONENT_EDGES`` edges is
walked once, in scan order, as a stream of sorted edges.  Only larger components go on
with rounds.  Every round's table is written to the shared checkpoint folder, so a lost
executor replays one step, and no plan grows with their number.  Vertices without edges
never enter the loop.

Equal normalized texts are collapsed first (one representative per text, the first in
scan order): all copies see the same earlier seeds with the same scores, so they land in
their representative's group.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import DedupConfig
from ..operators.dedup import GROUP_COLUMNS, _exact_scores, norm_key, number_groups
from ..session import cut_lineage, scratch_path
from .candidates import scored_edges, texts_of
from .components import component_labels
from .ordering import dense_index
from .skew import join_classes

SCORE_COLS = ["exact_match", "sequence_similarity", "levenshtein_similarity", "jaccard_similarity",
              "composite_similarity"]


#: Rounds on one plan before its result is written.
ROUNDS = 4
#: Components up to this size are walked by one task, as a stream.
COMPONENT_EDGES = 1_000_000
#: A vertex with more than this part of the edges has its state dealt to several tasks.
HOT_SHARE = 1000


def _dealt(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` with ``salt`` and ``salts``: edges of an earlier vertex that has more than a
    thousandth of all (a thousand such vertices at most, so they are broadcast) are dealt
    to as many parts as hold a thousandth each."""
    share = max(1, -(-total // HOT_SHARE))
    hot = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share) \
        .select(F.col("u").alias("_hot"), F.ceil(F.col("n") / share).cast("int").alias("salts"))
    out = edges.join(F.broadcast(hot), F.col("u") == F.col("_hot"), "left").drop("_hot")
    out = out.withColumn("salts", F.coalesce("salts", F.lit(1)))
    return out.withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"))


def _rounds(edges: DataFrame) -> DataFrame:
    """(x, seed) for every vertex after ``ROUNDS`` rounds; seed is null where still open."""
    salts = edges.groupBy("u").agg(F.max("salts").alias("salts")).withColumnRenamed("u", "x")
    verts = edges.select(F.col("u").alias("x")).union(edges.select(F.col("v").alias("x"))).distinct()
    now = cut_lineage(verts.join(salts, "x", "left").select("x", F.coalesce("salts", F.lit(1)).alias("salts"),
                                                            F.lit(None).cast("boolean").alias("seed")))
    for _ in range(ROUNDS):
        state = now.select(F.col("x").alias("u"), F.col("seed").alias("u_seed"),
                           F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
        seen = edges.join(state, ["u", "salt"]).groupBy("v").agg(
            F.max(F.coalesce("u_seed", F.lit(False))).alias("has_seed"), F.max(F.col("u_seed").isNull()).alias("open"))
        now = now.join(seen, F.col("x") == F.col("v"), "left").select(
            "x", "salts", F.when(F.col("seed").isNotNull(), F.col("seed"))
                           .when(F.coalesce("has_seed", F.lit(False)), F.lit(False))
                           .when(~F.coalesce("open", F.lit(False)), F.lit(True)).alias("seed"))
    return cut_lineage(now.select("x", "seed"))


def _walk(batches):
    """Members (vertices with an earlier seed neighbour) of components that arrive sorted by
    (component, v).  Memory holds the members of one component."""
    component, at, members, joined = None, None, set(), False
    for batch in batches:
        out_c, out_v = [], []
        for c, u, v in zip(*(batch[k].tolist() for k in ("component", "u", "v"))):
            if c != component or v != at:
                if joined:
                    members.add(at)
                    out_c.append(component)
                    out_v.append(at)
                if c != component:
                    members = set()
                component, at, joined = c, v, False
            joined = joined or u not in members
        yield pd.DataFrame({"x": out_v}, dtype="int64")
    if joined:
        yield pd.DataFrame({"x": [at]}, dtype="int64")


def _walk_components(edges: DataFrame) -> DataFrame:
    """Members of each component of ``edges`` (u, v, component; longs in scan order)."""
    dealt = edges.repartition("component").sortWithinPartitions("component", "v")
    return dealt.select("component", "u", "v").mapInPandas(_walk, "x long")


def greedy_seeds(edges: DataFrame, component_edges: int | None = None) -> DataFrame:
    """``edges(u, v)`` with u before v -> ``(x, seed)`` for every vertex on an edge."""
    limit = COMPONENT_EDGES if component_edges is None else component_edges
    spark = edges.sparkSession
    settled = scratch_path(spark, f"settled-{uuid.uuid4().hex}", scoped=True)
    edges = cut_lineage(edges.select("u", "v").distinct())
    while True:
        total = edges.count()
        state = _rounds(cut_lineage(_dealt(edges, total)))
        state.where("seed is not null").write.mode("append").parquet(settled)
        left = state.where("seed is null").select("x")
        # an open vertex has no seed before it, so only edges between open ones matter
        ends = left.select(F.col("x").alias("u")), left.select(F.col("x").alias("v"))
        edges = cut_lineage(edges.join(ends[0], "u", "left_semi").join(ends[1], "v", "left_semi"))
        rest = edges.count()
        if rest == 0:  # whoever is open has members before it only
            left.select("x", F.lit(True).alias("seed")).write.mode("append").parquet(settled)
            break
        numbers = cut_lineage(dense_index(left, [F.col("x")], "n"))  # in scan order
        a = numbers.select(F.col("x").alias("u"), F.col("n").alias("a"))
        b = numbers.select(F.col("x").alias("v"), F.col("n").alias("b"))
        plain = cut_lineage(edges.join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v")))
        if rest <= limit:
            grouped, large = plain.withColumn("component", F.lit(0).cast("long")), None
        else:
            labels = component_labels(plain).select(F.col("x").alias("v"), "component")
            sized = cut_lineage(plain.join(labels, "v"))
            # fewer than rest / limit components are larger: their number is bounded by that
            large = sized.groupBy("component").count().where(F.col("count") > limit).select("component")
            grouped = sized.join(F.broadcast(large), "component", "left_anti")
            large = cut_lineage(sized.join(F.broadcast(large), "component", "left_semi").select("u", "v"))
        members = cut_lineage(_walk_components(grouped)).select(F.col("x").alias("n"), F.lit(False).alias("seed"))
        decided = numbers.join(members, "n", "left")
        if large is not None:
            later = large.select(F.col("u").alias("n")).union(large.select(F.col("v").alias("n"))).distinct()
            decided = decided.join(later, "n", "left_anti")
        decided.select("x", F.coalesce("seed", F.lit(True)).alias("seed")).write.mode("append").parquet(settled)
        if large is None or large.isEmpty():
            break
        names = numbers.select(F.col("n").alias("u"), F.col("x").alias("a")), numbers.select(F.col("n").alias("v"), F.col("x").alias("b"))
        edges = cut_lineage(large.join(names[0], "u").join(names[1], "v").select(F.col("a").alias("u"), F.col("b").alias("v")))
    return spark.read.schema(state.schema).parquet(settled)


def fuzzy_groups(prep: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Duplicate groups for thresholds that unequal texts can reach."""
    # written once each: several branches read them, and concurrent jobs would each
    # recompute a merely persisted frame before its cache is filled
    rows = cut_lineage(prep.filter(F.col("content").isNotNull())
                           .select("id", "created_at", "sk", "norm", norm_key(F.col("norm")).alias("key")), "zstd")
    edges = cut_lineage(scored_edges(texts_of(rows), cfg))
    status = greedy_seeds(edges)
    seeds = status.filter(F.col("seed")).select(F.col("x").alias("u"))
    # member representative -> earliest seed neighbour, with that edge's scores
    claims = edges.join(seeds, "u", "left_semi")
    first = claims.groupBy("v").agg(F.min(F.struct("u", *SCORE_COLS)).alias("c"))
    member_reps = first.select(F.col("v").alias("rep_v"), F.col("c")["u"].alias("seed_v"),
                               *[F.col("c")[k].alias(k) for k in SCORE_COLS])
    # every row: its class representative, then that representative's seed
    classes = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("sk").alias("rep_v")))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # decide per class (one row each), then hand the decision to the class's rows
    decided = classes.join(member_reps, "rep_v", "left").withColumn("seed_sk", F.coalesce("seed_v", "rep_v")).drop("seed_v")
    sizes = decided.groupBy("seed_sk").agg(F.sum("n").alias("_n"))
    kept = cut_lineage(decided.join(sizes.filter(F.col("_n") > 1).select("seed_sk"), "seed_sk"))
    members = join_classes(rows.select("id", "created_at", "sk", "key"), kept, "key", "n", total)
    groups = number_groups(members.select("id", "created_at", "sk", "seed_sk", "rep_v", *SCORE_COLS))
    exact = _exact_scores(cfg.weights)
    in_seed_class = F.col("rep_v") == F.col("seed_sk")
    for c in SCORE_COLS:
        groups = groups.withColumn(c, F.when(F.col("is_seed"), F.lit(None).cast("double"))
                                   .when(in_seed_class, F.lit(float(exact[c])))
                                   .otherwise(F.col(c)))
    return groups.select(*GROUP_COLUMNS)
