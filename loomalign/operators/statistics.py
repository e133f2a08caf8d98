"""How surprising a score is: an extreme-value fit of scores to lengths, bit scores and E-values.  Built-in functions only.

Local scores of unrelated sequences follow an extreme-value distribution whose
place grows with the logarithm of the target's length.  The line of score on
ln(len) and the spread around it are taken over a query's targets, related ones
(``CENSOR`` spreads above the line) are left out, and the fit is made again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spreads above the line from which a target counts as related, and how often the fit is made.
CENSOR, ROUNDS = 5.0, 3
#: Euler's constant; the scale of an extreme-value distribution of variance 1, inverted.
EULER = 0.5772156649015329
SCALE = math.pi / math.sqrt(6)


def fit(scores: DataFrame, rounds: int = ROUNDS, censor: float = CENSOR) -> DataFrame:
    """(query_id, n, slope, place, spread) of scores (query_id, len, score): one row for each query.

    Targets without residues or score don't count.  Where all targets have one
    length the slope is 0; a query whose scores don't vary has spread 0.
    """
    rows = scores.where("score is not null and len > 0").select("query_id", F.log(F.col("len").cast("double")).alias("x"), F.col("score").cast("double").alias("y"))
    found = None
    for _ in range(rounds):
        part = rows
        if found is not None:
            z = F.col("y") - F.col("place") - F.col("slope") * F.col("x")
            part = rows.join(F.broadcast(found), "query_id").where(z <= censor * F.col("spread"))
        sums = part.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("c"), F.var_pop("y").alias("vy"))
        slope = F.when(F.col("vx") > 1e-12, F.col("c") / F.col("vx")).otherwise(0.0)
        found = sums.select("query_id", "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("place"), F.sqrt(F.greatest(F.lit(0.0), F.col("vy") - slope * F.col("c"))).alias("spread"))
    return found


def evalues(scores: DataFrame, query_len: dict[str, int] | None = None, rounds: int = ROUNDS, censor: float = CENSOR) -> DataFrame:
    """scores (query_id, target_id, len, score) with z, evalue and, where query_len is given, bits.

    z is 0 where nothing varies.  evalue: how many of the query's targets would
    score as much by chance.  bits: the score in which two random sequences of
    these lengths have m n / 2^bits such alignments.  Null without a score.
    """
    total = scores.where("score is not null").groupBy("query_id").agg(F.count("*").alias("_all"))
    known = fit(scores, rounds, censor).drop("n").join(total, "query_id")
    off = F.col("score") - F.col("place") - F.col("slope") * F.log(F.greatest(F.col("len"), F.lit(1)).cast("double"))
    z = F.when(F.col("score").isNull(), F.lit(None)).when(F.col("spread") > 1e-9, off / F.col("spread")).otherwise(0.0)
    rate = F.exp(-(F.col("z") * SCALE + EULER))
    # Where exp(-rate) would round to 1, the rate is the probability.
    out = scores.join(F.broadcast(known), "query_id", "left").withColumn("z", z).withColumn("evalue", F.col("_all") * F.when(rate < 1e-6, rate).otherwise(1 - F.exp(-rate)))
    columns = [*scores.columns, "z", "evalue"]
    if query_len is not None:
        m = F.element_at(F.create_map(*(F.lit(x) for pair in query_len.items() for x in pair)), F.col("query_id"))
        out = out.withColumn("bits", (F.log(m * F.greatest(F.col("len"), F.lit(1)).cast("double")) + F.col("z") * SCALE + EULER) / math.log(2))
        columns.append("bits")
    return out.select(*columns)
