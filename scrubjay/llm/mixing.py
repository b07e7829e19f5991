"""Temperature mixing of sources, realised as budgeted block permutations (operator 5).

A source with token share ``p`` gets weight proportional to ``p ** t``.  ``t`` is searched
between 0 (all sources alike) and 1 (shares as they are) for the flattest mix whose
largest repetition (weight * budget / tokens of the source) stays within
``max_repeats``; with ``target_entropy`` it is the mix of that share of the greatest
possible entropy, still within the limit.  Both measures are monotonic in ``t``, so an
interval that holds the answer is cut again and again.

A source whose budget is ``E`` times its tokens is passed over floor(E) times and once
more in part: an epoch orders its documents by a seeded hash, and the part takes
documents in that order while the tokens before them stay below the budget.  A document's
place in its source's sequence, as a share of the source's budget, gives its place in the
mix, so every block of the mix holds the sources in proportion to their weights; within a
block documents are permuted by another hash.

Texts are tokenised once, into slim rows (source, identity, tokens, copies), and all
decisions are made on those.  Token totals are summed over ranges of the hash (about
``RANGE_DOCS`` documents each) and then along the ranges, so no task orders a whole source.
:func:`mix` needs only each source's cut (the last place of its partial epoch that is
taken) and shuffles no text; :func:`write_mix` realises the permutation: files in ascending
order of block, each block in its permuted order, for which texts are shuffled by identity
and by place.

Edge cases: tokens are runs of other than white space; null, empty and blank texts have
none and pass with every whole epoch (with the first if there is none); a null source is
a source of its own; rows equal in doc_id, text and source stand at one place and pass
together; without tokens at all every row passes once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.llm.common import free_name, written
from scrubjay.plans.skew import join_classes

RANGE_DOCS = 2_000
CUTS, ROUNDS = 32, 6
BROADCAST_SOURCES = 100_000
SALTS = 64


@dataclass(frozen=True)
class MixConfig:
    budget_share: float = 1.0       # tokens of the mix, as a share of the input's
    max_repeats: float = 4.0        # passes over the most repeated source
    target_entropy: float | None = 0.95  # share of log(number of sources); None: as flat as the limit allows
    block_tokens: int = 1 << 20
    seed: int = 17


def _key(source: Column) -> Column:
    """Sources as text that a null cannot clash with."""
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measures(sources: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float]]:
    """(entropy, largest repetition) of the mix at each exponent: one aggregate over the
    sources for all exponents."""
    power = [F.exp(F.lit(t) * F.col("log_share")) for t in exponents]
    sums = sources.agg(*[F.sum(p).alias(f"z{i}") for i, p in enumerate(power)],
                       *[F.sum(p * F.lit(t) * F.col("log_share")).alias(f"e{i}") for i, (p, t) in enumerate(zip(power, exponents))],
                       *[F.max(p / F.col("tokens")).alias(f"m{i}") for i, p in enumerate(power)]).first()
    out = []
    for i in range(len(exponents)):
        z, e, m = sums[f"z{i}"], sums[f"e{i}"], sums[f"m{i}"]
        out.append((math.log(z) - e / z, m * budget / z))
    return out


def _part() -> Column:
    """A document's identity: 128 bits of its id, text and source (nulls marked)."""
    own = [F.col("doc_id"), F.col("text").cast("string"), F.col("source")]
    both = own + [c.isNull() for c in own]
    return F.concat_ws(":", F.xxhash64(*both), F.xxhash64(F.lit(1), *both))


def _slim(docs: DataFrame) -> DataFrame:
    """(source_key, part, tokens, copies): the one pass that tokenises texts."""
    rows = docs.select(_key(F.col("source")).alias("source_key"), _part().alias("part"), n_tokens(F.col("text")).alias("tokens"))
    return written(rows.groupBy("source_key", "part", "tokens").agg(F.count("*").alias("copies")), "mix-slim")


def weights(docs: DataFrame, config: MixConfig = MixConfig()) -> tuple[DataFrame, float]:
    """((source_key, docs, tokens, weight, epochs) per source, exponent)."""
    return _weights(_slim(docs), config)


def _weights(slim: DataFrame, config: MixConfig) -> tuple[DataFrame, float]:
    sources = written(slim.groupBy("source_key").agg(F.sum("copies").alias("docs"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens")), "mix-sources")
    total, count = sources.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    if not total:
        return sources.select("*", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs")), 1.0
    shares = written(sources.where("tokens > 0").withColumn("log_share", F.log(F.col("tokens") / F.lit(float(total)))), "mix-shares")
    budget = config.budget_share * total
    goal = None if config.target_entropy is None else config.target_entropy * math.log(count)

    def flat_enough(entropy: float, repeats: float) -> bool:
        """True where the exponent must not grow smaller."""
        return repeats > max(config.max_repeats, config.budget_share) + 1e-12 or (goal is not None and entropy > goal)

    # the smallest exponent that is not too flat; lo is too flat, hi is not
    lo, hi = 0.0, 1.0
    if not flat_enough(*_measures(shares, [0.0], budget)[0]):
        hi = 0.0
    else:
        for _ in range(ROUNDS):
            points = [lo + (hi - lo) * i / CUTS for i in range(1, CUTS)]
            over = [flat_enough(*m) for m in _measures(shares, points, budget)]
            first = next((i for i, o in enumerate(over) if not o), len(points))
            lo, hi = points[first - 1] if first else lo, points[first] if first < len(points) else hi
    z = shares.agg(F.sum(F.exp(F.lit(hi) * F.col("log_share")))).first()[0]
    weight = F.exp(F.lit(hi) * F.col("log_share")) / F.lit(z)
    mixed = shares.select("source_key", "docs", "tokens", weight.alias("weight"), (weight * F.lit(budget) / F.col("tokens")).alias("epochs"))
    rest = sources.where("tokens = 0").select("source_key", "docs", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"))
    return mixed.unionByName(rest), hi


def _with_sources(rows: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Join the table of sources: broadcast if it is small, else salted on both sides, since
    one source may hold a third of the rows."""
    small = table.select(F.col("source_key").alias(key), *columns)
    if table.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(small), key)
    salt = key + "_salt"
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)))
    copies = small.withColumn(salt, F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return dealt.join(copies, [key, salt]).drop(salt)


RANGE = ["source_key", "epoch", "range"]
LIMIT = "(epochs - epoch) * total"  # tokens of a partial epoch


def _order(config: MixConfig, epoch: str, part: str) -> Column:
    return F.xxhash64(F.lit(config.seed), epoch, F.col(part))


def _last_epoch(epochs: Column) -> Column:
    return F.greatest(F.ceil(epochs), F.lit(1)).cast("int") - 1


def _sequences(docs: DataFrame, config: MixConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, slim rows once per epoch they may be in, tokens before each range)."""
    slim = _slim(docs)
    table, _ = _weights(slim, config)
    table = written(table.withColumnRenamed("tokens", "total").withColumn("ranges", F.ceil(F.col("docs") / RANGE_DOCS).cast("long")), "mix-weights")
    rows = _with_sources(slim, table, "source_key", ["epochs", "ranges", "total"])
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), _last_epoch(F.col("epochs"))))).withColumn("order", _order(config, "epoch", "part"))
    unit = F.col("order") / F.lit(2.0 ** 64) + F.lit(0.5)
    rows = rows.withColumn("range", F.least(F.floor(unit * F.col("ranges")), F.col("ranges") - 1)).withColumn("own", F.col("tokens") * F.col("copies"))
    along = Window.partitionBy("source_key", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(rows.groupBy(*RANGE).agg(F.sum("own").alias("own")).select(*RANGE, F.coalesce(F.sum("own").over(along), F.lit(0)).alias("ahead")), "mix-ranges")
    return table, rows, ranges


def _placed(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """``rows`` of the given ranges with ``before``: the tokens of their epoch before them."""
    within = Window.partitionBy(*RANGE).orderBy("order", "part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(ranges, RANGE).withColumn("before", F.col("ahead") + F.coalesce(F.sum("own").over(within), F.lit(0)))


def _cuts(table: DataFrame, rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """(source_key, cut): the greatest order that a source's partial epoch takes.  Only the
    one range per source where the budget ends is put in order."""
    epochs = _with_sources(ranges, table, "source_key", ["epochs", "total"])
    reached = epochs.where(f"epochs - epoch < 1 and ahead < {LIMIT}").groupBy("source_key", "epoch").agg(F.max("range").alias("range"))
    ends = written(reached.join(ranges, RANGE), "mix-ends")
    return _placed(rows, ends).where(f"before < {LIMIT}").groupBy("source_key").agg(F.max("order").alias("cut"))


def mix(docs: DataFrame, config: MixConfig = MixConfig(), details: bool = False) -> DataFrame:
    """The mixed rows, with the columns of ``docs``; with ``details`` also tokens, epoch,
    position (0 to 1 in the mix), block and place_in_block (a hash to order a block by),
    under names with underscores before them where ``docs`` has such columns."""
    table, rows, ranges = _sequences(docs, config)
    own = [F.col(f"`{c}`") for c in docs.columns]
    n = {x: free_name(docs, f"_mix_{x}") for x in ("key", "part", "passes", "pass", "copies", "epoch")}
    if details:
        return _detailed(docs, config, table, rows, ranges, own, n)
    stats = table.join(_cuts(table, rows, ranges), "source_key", "left").select("source_key", F.struct("epochs", "cut").alias(n["pass"]))
    marked = docs.withColumn(n["key"], _key(F.col("source"))).withColumn(n["part"], _part())
    joined = _with_sources(marked, written(stats, "mix-cuts"), n["key"], [n["pass"]])
    epochs = F.col(n["pass"])["epochs"]
    passes = joined.withColumn(n["epoch"], F.explode(F.sequence(F.lit(0), _last_epoch(epochs))))
    has = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    partial = has & (_order(config, n["epoch"], n["part"]) <= F.col(n["pass"])["cut"])
    return passes.where((epochs - F.col(n["epoch"]) >= 1) | partial | (~has & (F.col(n["epoch"]) == 0))).select(*own)


DETAILS = ("tokens", "epoch", "position", "block", "place_in_block")


def _detailed(docs: DataFrame, config: MixConfig, table: DataFrame, rows: DataFrame, ranges: DataFrame, own: list[Column], n: dict[str, str]) -> DataFrame:
    """The mixed rows with their places: passes are decided and placed on slim rows, folded
    to one row per identity and joined to the documents last."""
    total = table.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(config.budget_share * total / config.block_tokens))
    taken = _placed(rows, ranges).where(f"epochs - epoch >= 1 or (tokens > 0 and before < {LIMIT}) or (tokens = 0 and epoch = 0)")
    position = F.when(F.col("total") > 0, F.least(F.lit(1.0), (F.col("epoch") + F.col("before") / F.col("total")) / F.col("epochs"))).otherwise(F.lit(0.0))
    placed = taken.withColumn("position", position).withColumn("block", F.least(F.floor(F.col("position") * blocks), F.lit(blocks - 1))).withColumn(
        "place_in_block", F.xxhash64(F.lit(config.seed + 1), "epoch", "part"))
    folded = written(placed.groupBy("part").agg(F.max("copies").alias(n["copies"]), F.collect_list(F.struct(*DETAILS)).alias(n["passes"])), "mix-passes")
    size = folded.agg(F.coalesce(F.sum(n["copies"]), F.lit(0))).first()[0]
    joined = join_classes(docs.withColumn(n["part"], _part()), folded.withColumnRenamed("part", n["part"]), n["part"], n["copies"], size)
    out = joined.select(*own, F.explode(n["passes"]).alias(n["pass"]))
    return out.select(*own, *[F.col(n["pass"])[c].alias(name) for c, name in zip(DETAILS, detail_names(docs))])


def detail_names(docs: DataFrame) -> list[str]:
    """The names that :func:`mix` gives its details for ``docs``."""
    return [free_name(docs, c) for c in DETAILS]


def write_mix(docs: DataFrame, path: str, config: MixConfig = MixConfig()) -> None:
    """Write the mix as Parquet in its order: file names ascend with the block, rows ascend
    by (block, place_in_block).  The files hold the columns of ``docs``, block and
    place_in_block (named as :func:`detail_names` says)."""
    *_, block, place = detail_names(docs)
    mixed = mix(docs, config, details=True)
    kept = written(mixed.select(*[F.col(f"`{c}`") for c in docs.columns], block, place), "mix-rows")
    kept.repartitionByRange(block, place).sortWithinPartitions(block, place).write.parquet(path)
