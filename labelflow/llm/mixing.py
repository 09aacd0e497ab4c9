"""Mix sources to target weights by temperature.

Source shares of tokens are raised to an exponent and normalised.  Entropy falls as the
exponent grows, from its largest value at 0; the exponent with the target entropy is
bisected below 1, or above it if asked, by grouped aggregates over the source table, many sections
at a time, so the number of sources may grow.  A repetition limit holds it back where
it would ask for more passes over one source.  The exponent is rounded to ``DIGITS``
digits.  Each source then gets a token budget: whole passes over its documents, and a
last pass cut where the budget ends.

A pass visits the source's blocks in a permuted order and the documents of a block
in hash order.  Where the last pass ends is one cut (block, document) per source:
block sums come from a grouped aggregate, and only documents of the one block that
holds the cut are ranked.  Rows are then kept or repeated by comparing their own
hashes with their source's cut; texts are never shuffled while the source table is
small enough to broadcast, which is measured.

The plan names the entropy share that the weights have and whether it is the target;
it is not if the repetition limit held the exponent back, if the sources are flatter and
were not to be sharpened, or if the largest of them are so alike that no exponent gets there.

Defined cases: a null text has no tokens; a source without tokens is kept once as it
is; a null source is a source of its own; rows that repeat an id in a source rank
together and stay or go together; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelflow import session
from labelflow.functions.columns import by_name

SECTIONS = 8
MAX_DOUBLINGS = 20
# Digits of the exponent, and how near its entropy share has to be to the target.
DIGITS = 6
MET = 1e-4
MAX_BLOCKS = 4096
# Relative error that weights and budgets may have as doubles.
EPSILON = 1e-9


@dataclass(frozen=True)
class Target:
    """``entropy`` is a share of the largest possible entropy; ``repeats`` the most passes over one source.

    Sources that are flatter than the target stay as they are, unless ``sharpen`` asks to meet it from there too.
    ``budget`` is the number of tokens to realise as a share of all tokens; it cannot be above ``repeats``.
    """

    entropy: float | None = 0.95
    repeats: float | None = 4.0
    budget: float = 1.0
    block_docs: int = 1000
    seed: int = 11
    sharpen: bool = False

    def __post_init__(self) -> None:
        if self.repeats is not None and self.budget > self.repeats:
            raise ValueError(f"a budget of {self.budget} passes is more than the {self.repeats} allowed over each source")


def tokens(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _sections(shares: DataFrame, cuts: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent the entropy's share of the largest possible one and the most passes over one source at budget 1."""
    total, top = shares.agg(F.sum("tokens"), F.max("tokens")).first()
    # Relative to the largest share, so that no power underflows as a whole.
    log_p, log_top = F.log(F.col("tokens") / F.lit(float(total))), math.log(top / total)
    sums = []
    for k, a in enumerate(cuts):
        log_w = F.lit(a) * (log_p - F.lit(log_top))
        sums += [F.sum(F.exp(log_w)).alias(f"z{k}"), F.sum(F.exp(log_w) * log_w).alias(f"l{k}"), F.max(F.exp(log_w - log_p)).alias(f"r{k}")]
    row = shares.agg(*sums, F.count(F.lit(1)).alias("count")).first()
    largest = math.log(row["count"]) or 1.0
    return [(a, (math.log(row[f"z{k}"]) - row[f"l{k}"] / row[f"z{k}"]) / largest, row[f"r{k}"] / row[f"z{k}"]) for k, a in enumerate(cuts)]


def _exponent(sources: DataFrame, target: Target) -> tuple[float, float, bool]:
    """The exponent, the entropy share it gives, and whether that is the target."""
    shares = sources.where("tokens > 0")
    if shares.agg(F.count(F.lit(1))).first()[0] < 2:
        return 1.0, 1.0, target.entropy is None
    ((_, plain, _),) = _sections(shares, [1.0])
    sharper = target.sharpen and target.entropy is not None and plain > target.entropy

    def passes(section: tuple[float, float, float]) -> bool:
        return target.repeats is None or section[2] * target.budget <= target.repeats * (1 + EPSILON)

    def inside(section: tuple[float, float, float]) -> bool:
        """Sharper: not yet beyond the target or the limit.  Flatter: the target and the limit are met."""
        if sharper:
            return section[1] >= target.entropy and passes(section)
        return (target.entropy is None or section[1] <= target.entropy) and passes(section)

    # Going up from 0 (or 1), the wanted exponent is where ``inside`` turns.
    cuts = [2.0**k for k in range(MAX_DOUBLINGS + 1)] if sharper else [k / SECTIONS for k in range(SECTIONS + 1)]
    while cuts[-1] - cuts[0] > 10.0 ** -(DIGITS + 2) * max(1.0, cuts[0]):
        found = _sections(shares, cuts)
        turned = next((k for k, section in enumerate(found) if inside(section) != sharper), len(cuts) - 1)
        if turned == 0:
            break
        low, high = cuts[turned - 1], cuts[turned]
        cuts = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
    exponent = round(cuts[0], DIGITS)
    ((_, entropy, _),) = _sections(shares, [exponent])
    return exponent, entropy, target.entropy is None or abs(entropy - target.entropy) <= MET


def _budget(wanted: Column, tokens: Column) -> Column:
    """Whole tokens of a wanted number; one that misses whole passes or whole tokens by the error of doubles is that number."""
    passes = F.when(tokens > 0, F.round(wanted / tokens) * tokens).otherwise(0.0)
    near = lambda whole: F.abs(wanted - whole) <= wanted * EPSILON
    return F.when(near(passes), passes).when(near(F.round(wanted)), F.round(wanted)).otherwise(F.floor(wanted)).cast("long")


def plan(docs: DataFrame, target: Target, source_col: str = "source") -> DataFrame:
    """One row per source: tokens, weight, budget, whole passes and the cut of the last one.

    ``docs`` has ``source_col``, ``doc_id`` and ``n_tokens``.
    """
    rows = docs.select(by_name(source_col).alias("source"), "doc_id", "n_tokens")
    sources = session.materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    exponent, entropy, met = _exponent(sources, target)
    total, top = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.greatest(F.max("tokens"), F.lit(1))).first()
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(top or 1)), F.lit(exponent))).otherwise(0.0)
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    weighted = sources.withColumn("weight", power / F.lit(norm))
    weighted = weighted.withColumn("budget", _budget(F.col("weight") * F.lit(target.budget * total), F.col("tokens")))
    weighted = weighted.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1))
    weighted = weighted.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0))
    weighted = weighted.withColumn("blocks", F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("docs") / target.block_docs)))
    weighted, seen = session.measure(weighted.withColumns({"exponent": F.lit(exponent), "entropy": F.lit(entropy), "met": F.lit(met)}), "weights", bytes=F.sum(F.octet_length("source")))

    placed = _placed(rows, weighted, seen, target)
    sums = placed.groupBy("source", "rest", "turn").agg(F.sum("n_tokens").alias("size"))
    order = Window.partitionBy("source").orderBy("turn")
    running = sums.withColumn("before", F.sum("size").over(order) - F.col("size"))
    # The block in which the rest runs out; all blocks before it fit whole.
    cut = running.where("before <= rest and before + size > rest").groupBy("source").agg(F.min(F.struct("turn", "before")).alias("at")).select("source", F.col("at.turn").alias("cut_turn"), "at.before")
    cut, cut_seen = session.measure(cut, "cuts", bytes=F.sum(F.octet_length("source")))
    # Only the documents of that block are ranked.
    last = placed.join(session.broadcast_if_small(cut, cut_seen), placed["source"].eqNullSafe(cut["source"]) & (F.col("turn") == F.col("cut_turn"))).drop(cut["source"])
    inside = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = last.withColumn("reached", F.col("before") + F.sum("n_tokens").over(inside))
    ends = ranked.where("reached <= rest").groupBy("source").agg(F.max("place").alias("cut_place"))
    out = weighted.alias("w").join(cut.alias("c"), F.col("w.source").eqNullSafe(F.col("c.source")), "left")
    out = out.join(ends.alias("e"), F.col("w.source").eqNullSafe(F.col("e.source")), "left")
    return session.materialize(out.select("w.*", "cut_turn", "cut_place"), "plan")


def _hash(*parts: Column) -> Column:
    """A number of 60 bits from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def _turn(source: Column, passes: Column, block: Column, seed: int) -> Column:
    """Where a block comes in the permutation of a pass."""
    return _hash(F.lit(seed), passes, block, F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")))


def _place(doc_id: Column, seed: int) -> Column:
    return _hash(F.lit(seed + 1), F.coalesce(doc_id.cast("string"), F.lit("")))


def _block(doc_id: Column, blocks: Column, seed: int) -> Column:
    return _hash(F.lit(seed + 2), F.coalesce(doc_id.cast("string"), F.lit(""))) % blocks


def _placed(rows: DataFrame, weighted: DataFrame, seen: dict, target: Target) -> DataFrame:
    """Documents of sources with a cut, with their block's turn and their place in it."""
    small = weighted.where("rest > 0").select(F.col("source").alias("s"), "passes", "rest", "blocks")
    joined = rows.join(session.broadcast_if_small(small, seen), F.col("source").eqNullSafe(F.col("s")))
    turn = _turn(F.col("source"), F.col("passes"), _block(F.col("doc_id"), F.col("blocks"), target.seed), target.seed)
    return joined.select("source", "n_tokens", "rest", turn.alias("turn"), _place(F.col("doc_id"), target.seed).alias("place"))


def realise(docs: DataFrame, weights: DataFrame, target: Target, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` once per pass that visits them, with ``copy`` and ``turn`` (the block's place in that pass) in ``__mix``."""
    seen = weights.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("source")).alias("bytes")).first().asDict()
    small = weights.select(F.struct("source", "passes", "blocks", "rest", "cut_turn", "cut_place").alias("__w"))
    joined = docs.join(session.broadcast_if_small(small, seen), by_name(source_col).eqNullSafe(F.col("__w.source")))
    doc_id, w = by_name(id_col), lambda c: F.col(f"__w.{c}")
    block = _block(doc_id, w("blocks"), target.seed)
    turn = lambda k: _turn(w("source"), k, block, target.seed)
    last = turn(w("passes"))
    fits = (last < w("cut_turn")) | ((last == w("cut_turn")) & (_place(doc_id, target.seed) <= w("cut_place")))
    copies = w("passes") + F.when((w("rest") > 0) & F.coalesce(fits, F.lit(False)), 1).otherwise(0)
    repeated = joined.withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), (copies - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
    mix = F.struct("__copy", turn(F.col("__copy").cast("long")).alias("turn"))
    return repeated.select(*[by_name(c) for c in docs.columns], mix.alias("__mix"))


def mix(docs: DataFrame, target: Target = Target(), source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` mixed to the target, as rows of ``docs``."""
    counted = docs.select(by_name(source_col).alias("source"), by_name(id_col).alias("doc_id"), tokens(by_name(text_col)).alias("n_tokens"))
    counted = session.materialize(counted, "counted")
    return realise(docs, plan(counted, target), target, source_col, id_col).drop("__mix")
