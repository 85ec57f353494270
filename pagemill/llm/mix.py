"""One training set from several sources with target shares, by Pfair scheduling of equal blocks.

Each source's stream of texts is cut into units of equal token counts, two to a block. Unit ``j`` of a source with weight
``w`` is released at slot ``floor(j / w)`` and due at ``ceil((j + 1) / w)``; earliest deadline first then keeps every source
within one unit of its line. Slots are scheduled in epochs: the units of each source before an epoch are its line rounded
by largest remainders, again within one unit, so epochs are scheduled apart from each other, each in its own task, and
every source stays within two units, one block, of its share at every moment.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.tokens import VOCABULARY, with_token_counts
from pagemill.session import materialize

#: Sources of the table of targets; it is a control table, more of them are an error.
MOST_SOURCES = 10_000


@dataclass(frozen=True)
class Plan:
    """``slots`` slots of one unit each; ``weights`` (they sum to 1) of the sources that take part, in order."""

    sources: tuple[str, ...]
    weights: tuple[Fraction, ...]
    slots: int
    epoch: int

    @property
    def epochs(self) -> int:
        return max(1, self.slots // self.epoch) if self.slots else 0

    def before(self, slot: int) -> list[int]:
        """Units of each source before ``slot``: weight times slot by largest remainders."""
        lines = [w * slot for w in self.weights]
        whole = [math.floor(x) for x in lines]
        order = sorted(range(len(lines)), key=lambda s: (whole[s] - lines[s], s))
        for s in order[: slot - sum(whole)]:
            whole[s] += 1
        return whole

    def bounds(self, epoch: int) -> tuple[int, int]:
        """First slot of an epoch and the one after its last; the last epoch takes the remainder."""
        return epoch * self.epoch, self.slots if epoch == self.epochs - 1 else (epoch + 1) * self.epoch


def make_plan(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None, unit: int, least_epoch: int = 4096) -> Plan:
    """Weights and number of slots. Without ``total`` the most for which every source that has texts meets its share.

    A greater ``total`` is filled as far as the caps allow: a source at its cap gives what it has, and the rest is
    shared among the others by weight. Sources without texts give nothing, their share goes to the others. A cap counts
    in whole units; a source with less than one unit may give it all in one short slot.

    An epoch has at least ``1 / w`` slots of the least weight ``w``, so that the units before it never fall.
    """
    live = sorted((s, Fraction(w), r * available[s]) for s, w, r in targets if w > 0 and r > 0 and available.get(s, 0) > 0)
    caps = {s: Fraction(max(c // unit, 0)) or Fraction(c, unit) for s, _, c in live}
    weight = {s: w for s, w, _ in live}
    if not live:
        return Plan((), (), 0, least_epoch)
    whole = sum(weight.values())
    left = min(caps[s] * whole / weight[s] for s in weight) if total is None else Fraction(max(int(total), 0), unit)
    units: dict[str, Fraction] = {}
    open_ = dict(weight)
    while open_:
        whole = sum(open_.values())
        full = [s for s in open_ if caps[s] <= left * open_[s] / whole]
        if not full:
            units |= {s: left * w / whole for s, w in open_.items()}
            break
        for s in full:
            units[s] = caps[s]
            left -= caps[s]
            del open_[s]
    taking = sorted(s for s, n in units.items() if n > 0)
    all_units = sum(units[s] for s in taking)
    if not taking:
        return Plan((), (), 0, least_epoch)
    weights = tuple(units[s] / all_units for s in taking)
    return Plan(tuple(taking), weights, math.floor(all_units), max(least_epoch, math.ceil(1 / min(weights))))


def epoch_slots(plan: Plan, epoch: int):
    """``(slot, source number, unit)`` of one epoch: earliest deadline first among the released units, slot by slot."""
    first, end = plan.bounds(epoch)
    start, after = plan.before(first), plan.before(end)
    length, count = end - first, [b - a for a, b in zip(start, after)]
    waiting = [(0, s, 0) for s, n in enumerate(count) if n]
    heapq.heapify(waiting)
    released: list[tuple[int, int, int]] = []
    for slot in range(length):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(released, (-((j + 1) * -length // count[s]), s, j))
        _, s, j = heapq.heappop(released)
        yield first + slot, s, start[s] + j
        if j + 1 < count[s]:
            heapq.heappush(waiting, ((j + 1) * length // count[s], s, j + 1))


def schedule(spark, plan: Plan) -> DataFrame:
    """``slot, source, unit`` of all slots, epoch by epoch in the executors; no row of it passes the driver."""

    def run(batches):
        for b in batches:
            for epoch in b["id"]:
                rows = []
                for slot, s, unit in epoch_slots(plan, int(epoch)):
                    rows.append((slot, plan.sources[s], unit))
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=["slot", "source", "unit"])
                        rows = []
                yield pd.DataFrame(rows, columns=["slot", "source", "unit"])

    return spark.range(plan.epochs).mapInPandas(run, "slot long, source string, unit long")


def _counted(documents: DataFrame, path: str) -> DataFrame:
    """``source, digest, doc_id, n_tokens`` of each distinct text of each source.

    Copies of a text under other ids are one text, else it could be used more often than allowed.
    """
    rows = documents.where("text IS NOT NULL AND text <> '' AND source IS NOT NULL").select("doc_id", "source", "text", F.sha2("text", 256).alias("digest"))
    counted = with_token_counts(rows.select("doc_id", "source", "digest", "text"), path=path)
    per_text = counted.groupBy("digest", "source").agg(F.min("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"))
    return materialize(per_text, "token-counts")


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 2048, rows_per_bucket: int = 50_000, seed: int = 7, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """``(rows, report)``: ``slot, source, position, doc_id, repeat_no, start_token, end_token, n_tokens`` and the shares reached.

    A row is the span of a text's tokens that lies in one slot: a long text runs through as many slots of its source as
    it needs, and the one at a source's end is cut there. Ordering ``rows`` by ``slot, position`` gives the training set. At
    every slot every source lies within ``block_tokens`` tokens of its share of what stands before. Only one row per
    source passes the driver (``MOST_SOURCES`` at most). Positions come from a two-level prefix sum, so no source, however
    large its part of all rows, is sorted in one task.

    Defined results: null or empty texts and sources without a target are left out; a source without texts is
    reported with share 0 and its share goes to the others in proportion; equal texts count once, whatever their ids, in the
    target source with the fewest tokens; several targets of a source are added up and the least ``max_repeats``
    holds; targets of null, zero or less are ignored; texts that fill no unit of half a block give no rows.
    """
    spark = documents.sparkSession
    unit = max(1, block_tokens // 2)
    wanted = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("w"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("r"))
    named = [(x["source"], float(x["w"]), int(x["r"])) for x in wanted.orderBy("source").limit(MOST_SOURCES + 1).collect()]
    if len(named) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the targets")
    texts = _counted(documents.join(F.broadcast(spark.createDataFrame([(s,) for s, _, _ in named], "source string")), "source", "left_semi"), path)
    sizes = texts.groupBy("source").agg(F.sum("n_tokens").alias("n")).withColumnRenamed("source", "s")
    owner = texts.join(F.broadcast(sizes), F.col("source") == F.col("s")).groupBy("digest").agg(F.min_by(F.struct("source", "doc_id", "n_tokens"), F.struct("n", "source")).alias("t")).select("t.*")
    owned = materialize(owner.where("n_tokens > 0"), "mix-texts")
    totals = {x["source"]: (int(x["n"]), int(x["rows"])) for x in owned.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()}
    plan = make_plan(named, {s: n for s, (n, _) in totals.items()}, total_tokens, unit)
    given = dict(zip(plan.sources, plan.before(plan.slots)))
    caps = {s: r * totals.get(s, (0, 0))[0] for s, _, r in named}
    taken = [(s, min(n * unit, caps[s]), totals[s][0]) for s, n in given.items() if n]

    n_buckets = max(1, math.ceil(max((rows for _, rows in totals.values()), default=1) / rows_per_bucket))
    keyed = owned.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(n_buckets)).cast("int"))
    before = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = before.withColumn("offset", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).select("source", "bucket", "offset")
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("upto", F.sum("n_tokens").over(inner)).join(before, ["source", "bucket"]).withColumn("start", F.col("offset") + F.col("upto") - F.col("n_tokens"))
    per_source = spark.createDataFrame([(s, q, n, -(-q // n)) for s, q, n in taken], "source string, quota long, all_tokens long, passes int")
    uses = (
        placed.join(F.broadcast(per_source), "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        .withColumn("first", F.col("start") + F.col("repeat_no") * F.col("all_tokens")).where("first < quota")
        .withColumn("last", F.least(F.col("first") + F.col("n_tokens"), F.col("quota")))
    )
    size = F.lit(unit).cast("long")
    floor = lambda c: F.floor(c / size).cast("long")
    spans = uses.withColumn("unit", F.explode(F.sequence(floor(F.col("first")), floor(F.col("last") - 1))))
    spans = spans.withColumn("position", F.greatest("first", F.col("unit") * size)).withColumn("upto", F.least("last", (F.col("unit") + 1) * size))
    rows = spans.join(schedule(spark, plan), ["source", "unit"]).select(
        "slot", "source", "position", "doc_id", "repeat_no", (F.col("position") - F.col("first")).alias("start_token"), (F.col("upto") - F.col("first")).alias("end_token"), (F.col("upto") - F.col("position")).alias("n_tokens"))
    reached = uses.groupBy("source").agg(F.sum(F.col("last") - F.col("first")).alias("tokens"), F.count("*").alias("n_uses"), F.max(F.col("repeat_no") + 1).alias("most_uses"))
    targets_df = spark.createDataFrame([(s, w, r, totals.get(s, (0, 0))[0]) for s, w, r in named], "source string, target_share double, max_repeats int, available_tokens long")
    whole = sum(q for _, q, _ in taken)
    report = targets_df.join(F.broadcast(reached), "source", "left").select(
        "source", "target_share", "max_repeats", "available_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        (F.coalesce("tokens", F.lit(0)) / F.lit(max(whole, 1))).alias("share"))
    return rows, report
