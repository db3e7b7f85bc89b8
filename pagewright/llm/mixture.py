"""Problem 9: mix sources to target shares of tokens.

Entropy balancing.  Every record of source s gets a rate w, of least relative entropy to one copy
each, under two constraints a source: its tokens add up to its share of the total, and its
mean record size stays as it is.  The dual is convex, and its solution tilts exponentially:

    w = min(cap_s, exp(a_s + b_s * size / mean size of s))

Newton steps find a and b.  Each step is one distributed aggregation of the clipped sums,
gradient and Hessian by source; only two numbers a source come to the driver.  Rates are then
rounded into copies: the whole part, and one more where a hash of the record lies under the
fraction; the hash threshold of each source is moved until its tokens come out right.

The queries give ``CORPUS`` as the total: the tokens of all documents.  Every source gets its share of that or, where
it is short, all records at its cap; the shares reached show it.  What short sources lack is not passed on to others, which
would take all shares further from their targets.  ``total_tokens`` may also be a number.  Without it the total is the
largest at which every source that has tokens can reach its target within its cap; the smallest source then sizes the
whole mixture, and a source without tokens reaches 0 while the others share its part in proportion to their targets.
Sources without a target (null ones too) and records without tokens get no copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import token_sizes

#: Bins of the hash threshold; one refinement takes it to 1 / BINS**2.
BINS = 1024
STEPS = 40
#: As a total: the tokens of all documents.
CORPUS = "corpus"


def _number(values: dict[str, float], otherwise: float = 0.0) -> Column:
    """A source's number, as an expression over the few sources that have a target."""
    out = F.lit(float(otherwise))
    for source, v in values.items():
        out = F.when(F.col("source") == source, F.lit(float(v))).otherwise(out)
    return out


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """The small table of targets; several rows of one source add their shares up."""
    rows = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap")).collect()
    return {r.source: (float(r.share), max(0, int(r.cap))) for r in rows}


def balance(sizes: DataFrame, tokens: dict[str, float], records: dict[str, float], wanted: dict[str, float], caps: dict[str, int]) -> dict[str, tuple[float, float]]:
    """The dual's solution (a, b) by source; ``sizes`` has (source, n_tokens, n).

    A source whose wanted tokens need every record at its cap is held at the cap (a = inf).
    """
    mean = {s: tokens[s] / records[s] for s in wanted}
    # Steps begin below the cap, where rates can move, and are never longer than 1.
    dual = {s: (min(0.0, math.log(caps[s]) - 0.5), 0.0) for s in wanted if wanted[s] < caps[s] * tokens[s] * (1 - 1e-12)}
    held = {s: (math.inf, 0.0) for s in wanted if s not in dual}
    done: dict[str, tuple[float, float]] = {}
    for _ in range(STEPS):
        if not dual:
            break
        z = F.col("n_tokens") / _number({s: mean[s] for s in dual}, 1.0)
        raw = F.exp(F.least(_number({s: v[0] for s, v in dual.items()}) + _number({s: v[1] for s, v in dual.items()}) * z, F.lit(50.0)))
        cap = _number({s: float(caps[s]) for s in dual})
        w = F.least(raw, cap) * F.col("n")
        free = F.when(raw < cap, w).otherwise(0.0)  # clipped rates don't move
        sums = sizes.where(F.col("source").isin(list(dual))).groupBy("source").agg(
            *[F.sum(w * z**p).alias(f"g{p}") for p in (0, 1)], *[F.sum(free * z**p).alias(f"h{p}") for p in (0, 1, 2)]
        )
        for r in sums.collect():
            s, (a, b) = r.source, dual[r.source]
            goal = wanted[s] / mean[s]
            d0, d1 = goal - r.g0, goal - r.g1
            if abs(d0) + abs(d1) < 1e-9 * goal or r.h0 <= 0:
                done[s] = dual.pop(s)
                continue
            det = r.h0 * r.h2 - r.h1 * r.h1
            if det > 1e-9 * r.h0 * r.h2:
                da, db = (r.h2 * d0 - r.h1 * d1) / det, (r.h0 * d1 - r.h1 * d0) / det
            else:  # all records of one size
                da, db = d1 / r.h1 if r.h1 else 0.0, 0.0
            big = max(abs(da), abs(db), 1.0)
            dual[s] = (a + da / big, b + db / big)
    return done | dual | held


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: float | str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies) of every document."""
    goal = _targets(targets)
    share, cap = {s: v[0] for s, v in goal.items()}, {s: v[1] for s, v in goal.items()}
    rows = cut(token_sizes(docs, ["doc_id", "source"]))
    known = rows.where(F.col("source").isin(list(goal)) & (F.col("n_tokens") > 0))
    sizes = cut(known.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    sums = sizes.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("tokens"), F.sum("n").alias("records")).collect()
    tokens, records = {r.source: float(r.tokens) for r in sums}, {r.source: float(r.records) for r in sums}
    live = [s for s in goal if tokens.get(s, 0) > 0 and cap[s] > 0]
    whole = sum(share[s] for s in live)
    if total_tokens is None:
        total = min((cap[s] * tokens[s] * whole / share[s] for s in live), default=0.0)
        wanted = {s: share[s] / whole * total for s in live}
    else:
        total = float(rows.agg(F.sum("n_tokens")).first()[0] or 0) if total_tokens == CORPUS else float(total_tokens)
        wanted = {s: min(share[s] * total, cap[s] * tokens[s]) for s in live}
    dual = balance(sizes, tokens, records, wanted, cap)

    z = F.col("n_tokens") / _number({s: tokens[s] / records[s] for s in live}, 1.0)
    a, b = ({s: min(v[k], 60.0) for s, v in dual.items()} for k in (0, 1))
    rate = F.when(F.col("source").isin(live) & (F.col("n_tokens") > 0), F.least(F.exp(F.least(_number(a) + _number(b) * z, F.lit(50.0))), _number({s: float(cap[s]) for s in live}))).otherwise(0.0)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("gap", F.col("rate") - F.col("whole") - chance)
    shift = _thresholds(rows, wanted)
    more = (F.col("gap") + _number(shift) > 0) & (F.col("rate") > 0) & (F.col("whole") < _number({s: float(cap[s]) for s in live}))
    copies = F.col("whole") + F.when(more, 1).otherwise(0)
    return rows.select("doc_id", "source", "n_tokens", F.round("rate", 9).alias("rate"), copies.cast("int").alias("copies"))


def _thresholds(rows: DataFrame, wanted: dict[str, float]) -> dict[str, float]:
    """Per source the shift of the hash threshold at which the copies' tokens come closest."""
    low, width = dict.fromkeys(wanted, -1.0), 2.0
    for last in (False, True):  # the second time within the bin that the first has found
        width /= BINS
        # Records with a whole rate have no fraction and stay; ``gap`` lies in (-1, 1).
        bin_no = F.ceil((-F.col("gap") - _number(low)) / width)
        part = F.col("rate") > F.col("whole")
        sums = (
            rows.where(F.col("rate") > 0)
            .withColumn("bin", F.when(part, F.least(F.greatest(bin_no, F.lit(0)), F.lit(BINS + 1))).otherwise(F.lit(-1)))
            .groupBy("source", "bin")
            .agg(F.sum(F.col("n_tokens") * F.col("whole")).alias("base"), F.sum("n_tokens").alias("t"))
            .collect()
        )
        for s in wanted:
            own = sorted((r.bin, float(r.base), float(r.t)) for r in sums if r.source == s)
            have = sum(r[1] for r in own) + sum(r[2] for r in own if r[0] == 0)
            at = low[s]
            for k, _, t in own:
                if 1 <= k <= BINS and have + t <= wanted[s]:
                    have += t
                    at = low[s] + k * width
                elif k >= 1:
                    at = low[s] + (min(k, BINS + 1) - 1) * width
                    if last and k <= BINS and have + t - wanted[s] < wanted[s] - have:
                        at += width  # going over comes closer
                    break
            low[s] = at
    return low


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, available_tokens, mixed_tokens, records, copies, max_copies) of each target."""
    sums = mix.groupBy("source").agg(
        F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"),
        F.count("*").alias("records"), F.sum("copies").alias("copies"), F.max("copies").alias("max_copies"),
    )
    out = targets.select("source", "target_share").join(sums, "source", "left").na.fill(0)
    total = sums.agg(F.sum("mixed_tokens")).first()[0] or 0  # one value
    out = out.withColumn("all_tokens", F.lit(total).cast("long"))
    return out.select("source", "target_share", F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"), "available_tokens", "mixed_tokens", "records", "copies", "max_copies")
