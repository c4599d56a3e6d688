"""Mixing sources to target weights by entropy balancing.

Document i with t tokens gets the token mass p, proportional to t * exp(lambda . x), closest in relative entropy to
its natural mass among those that meet the token constraints: the share of each source, the share of each language,
and the mean centred log length. The dual is convex. Given the multipliers of languages and length, the best one of a
source is known in closed form, log(target / its mass), so the Newton iterations run on the rest alone, the reduced dual

    sum over sources s of target_s * log sum over i in s of t exp(theta . x)  -  theta . wanted.

Each iteration is one aggregation of the documents to moments of source x language, and of these, over sources, to the
gradient and the curvature, of which the driver gets one number a pair of languages. Sources, which may be very many,
stay in tables. The rate of a document is c * exp(lambda . x), with c such that the least rate is 1, so mixing repeats
documents and never loses one. A rate is rounded to copies: its whole part, and one more where a hash of the row falls
below its fraction, so that the expected copies equal the rate.

Cases: a null source or language is a category of its own; null and blank texts have no tokens, carry no mass and get
the rate of their cell; sources without tokens have no constraint and aren't tilted. A table without tokens gets rate 1
throughout. Targets of sources that don't occur are left out; a source with tokens but without a target above 0 raises
``ValueError``. Targets that no rates meet along with the shares of languages and the mean length, so that the iterations
don't converge, are met alone, with a warning: all documents of a source get one rate. Repeated rows and null or repeated ``doc_id`` are rows like any other,
and extra columns are carried by the filter whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

#: Target share of a source: its natural share to this power, normalized. 1 changes nothing, 0 levels the sources.
ALPHA = 0.9
#: A log rate beyond which the iterations are taken to run away.
_FAR = 30.0


def token_count(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")


def _key(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


@dataclass
class Balance:
    """A solved dual: cells (source, lang, offset), the slope for centred log length, its centre, and log c.

    ``whole``: besides the targets of sources those of languages and length are met.
    """

    cells: DataFrame
    slope: float
    centre: float
    scale: float
    iterations: int
    whole: bool = True


def _targets(base: DataFrame, total: float, targets: dict[str | None, float] | None, default: float | None, alpha: float) -> DataFrame:
    """(source, target) of the sources with tokens; targets add up to 1."""
    sources = base.where("tokens > 0").groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"))
    if targets is None:
        weighed = sources.select("source", F.pow(F.col("t") / F.lit(float(total)), F.lit(alpha)).alias("w"))
    else:
        given = base.sparkSession.createDataFrame([("null" if s is None else f"={s}", float(w)) for s, w in targets.items()], "source string, given double")
        weighed = sources.join(given, "source", "left").select("source", F.coalesce("given", F.lit(default).cast("double")).alias("w"))
    weighed = materialize(weighed, "targets")
    norm, least = weighed.agg(F.sum("w"), F.min(F.coalesce("w", F.lit(0.0)))).first()
    if not least > 0 or not math.isfinite(norm):
        raise ValueError("every source with tokens needs a target above 0")
    return weighed.select("source", (F.col("w") / F.lit(norm)).alias("target"))


def _moments(base: DataFrame, theta: DataFrame, slope: float, centre: float) -> DataFrame:
    """(source, lang, offset, m0, m1, m2, lo, hi) of the tilted masses, and the least and largest centred log length."""
    z = F.log1p("tokens") - F.lit(centre)
    mass = F.col("tokens") * F.col("n") * F.exp(F.lit(slope) * z)
    cells = base.groupBy("source", "lang").agg(F.sum(mass).alias("m0"), F.sum(mass * z).alias("m1"), F.sum(mass * z * z).alias("m2"), F.min(z).alias("lo"), F.max(z).alias("hi"))
    w = F.exp("offset")
    return cells.join(theta, "lang", "left").fillna({"offset": 0.0}).select("source", "lang", "offset", (w * F.col("m0")).alias("m0"), (w * F.col("m1")).alias("m1"), (w * F.col("m2")).alias("m2"), "lo", "hi")


def _curvature(cells: DataFrame, wanted: DataFrame, at: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of (languages, z), averaged over sources by their targets."""
    total = F.sum("m0").alias("mass"), F.sum("m1").alias("m1"), F.sum("m2").alias("m2")
    by = cells.where("m0 > 0").groupBy("source").agg(*total, F.collect_list(F.struct("lang", "m0", F.col("m1").alias("m"))).alias("own")).join(wanted, "source")
    by = by.select("target", (F.col("m1") / F.col("mass")).alias("ez"), (F.col("m2") / F.col("mass")).alias("ezz"), F.transform("own", lambda x: F.struct(x["lang"].alias("lang"), (x["m0"] / F.col("mass")).alias("p"), (x["m"] / F.col("mass")).alias("pz"))).alias("own"))
    one = by.select("target", "ez", "own", F.explode("own").alias("a"))
    single = one.groupBy("a.lang").agg(F.sum(F.col("target") * F.col("a.p")).alias("p"), F.sum(F.col("target") * (F.col("a.pz") - F.col("a.p") * F.col("ez"))).alias("pz"))
    double = one.select("target", "a", F.explode("own").alias("b")).groupBy(F.col("a.lang").alias("l"), F.col("b.lang").alias("m")).agg(F.sum(F.col("target") * F.col("a.p") * F.col("b.p")).alias("pp"))
    ez, var = by.agg(F.sum(F.col("target") * F.col("ez")), F.sum(F.col("target") * (F.col("ezz") - F.col("ez") * F.col("ez")))).first()
    d = len(at) + 1
    mean, second = np.zeros(d), np.zeros((d, d))
    mean[-1], second[-1, -1] = ez, var
    for r in single.collect():
        i = at[r["lang"]]
        mean[i] = r["p"]
        second[i, i] += r["p"]
        second[i, -1] = second[-1, i] = r["pz"]
    for r in double.collect():
        second[at[r["l"]], at[r["m"]]] -= r["pp"]
    return mean, second


def solve(base: DataFrame, targets: dict[str | None, float] | None = None, alpha: float = ALPHA, default: float | None = None, tolerance: float = 1e-10, most: int = 30) -> Balance:
    """Newton iterations over ``base`` (source, lang, tokens, n): ``n`` documents of each kind.

    ``targets`` are weights by source, normalized here; ``default`` is that of sources without one.
    """
    spark = base.sparkSession
    total, logs = base.agg(F.sum(F.col("tokens") * F.col("n")), F.sum(F.col("tokens") * F.col("n") * F.log1p("tokens"))).first()
    if not total:
        return Balance(base.select("source", "lang", F.lit(0.0).alias("offset")).distinct(), 0.0, 0.0, 0.0, 0)
    centre = logs / total
    wanted = _targets(base, total, targets, default, alpha)
    natural = {r["lang"]: float(r["t"]) / float(total) for r in base.where("tokens > 0").groupBy("lang").agg(F.sum(F.col("tokens") * F.col("n")).alias("t")).collect()}
    langs = sorted(natural)
    at, b = {x: i for i, x in enumerate(langs)}, np.array([*(natural[x] for x in langs), 0.0])
    theta = np.zeros(len(b))
    moments = lambda x: materialize(_moments(base, spark.createDataFrame([(v, float(x[at[v]])) for v in langs], "lang string, offset double"), float(x[-1]), centre), "cells")
    whole = False
    for iterations in range(most + 1):
        cells = moments(theta)
        mean, second = _curvature(cells, wanted, at)
        gradient = mean - b
        if np.isfinite(second).all() and np.abs(gradient).max() < tolerance:
            whole = True
            break
        if not np.isfinite(second).all() or np.abs(theta).max() > _FAR:
            break
        step = np.linalg.lstsq(second, gradient, rcond=1e-13)[0]
        decrement = math.sqrt(max(0.0, float(gradient @ step)))
        theta = theta - (step if decrement < 0.5 else step / (1 + decrement))
        discard(cells)
    if not whole:
        warnings.warn("no rates meet the targets of sources along with the shares of languages and the mean length", stacklevel=2)
        theta = np.zeros(len(b))
        cells = moments(theta)
    mass = cells.where("m0 > 0").groupBy("source").agg(F.sum("m0").alias("mass")).join(wanted, "source").select("source", F.log(F.col("target") / F.col("mass")).alias("own"))
    full = cells.join(mass, "source", "left").select("source", "lang", (F.col("offset") + F.coalesce("own", F.lit(-math.log(total)))).alias("offset"), "lo", "hi")
    full = materialize(full, "offsets")
    slope = float(theta[-1])
    least = full.agg(F.min(F.col("offset") + F.least(F.lit(slope) * F.col("lo"), F.lit(slope) * F.col("hi")))).first()[0]
    return Balance(full.select("source", "lang", "offset"), slope, centre, -float(least), iterations, whole)


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("source")).alias("source"), _key(F.col("lang")).alias("lang"), token_count(F.col("text")).alias("tokens"))


def _kinds(docs: DataFrame) -> DataFrame:
    """(source, lang, tokens, n): how many documents there are of each kind."""
    return materialize(_base(docs).groupBy("source", "lang", "tokens").agg(F.count("*").alias("n")), "kinds")


def _with_copies(rows: DataFrame, balance: Balance) -> DataFrame:
    """``rows`` (source, lang, tokens, doc_id under ``__`` names) with ``__rate`` and ``__copies``."""
    cells = balance.cells.select(F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("offset").alias("__offset"))
    joined = rows.join(cells, (F.col("__source") == F.col("__s")) & (F.col("__lang") == F.col("__l")), "left")
    tilt = F.coalesce("__offset", F.lit(0.0)) + F.lit(balance.slope) * (F.log1p("__tokens") - F.lit(balance.centre)) + F.lit(balance.scale)
    rate = F.greatest(F.lit(1.0), F.exp(tilt))
    draw = F.pmod(F.xxhash64("__doc", "__source", "__tokens"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return joined.withColumn("__rate", rate).withColumn("__copies", (F.floor("__rate") + (draw < F.col("__rate") - F.floor("__rate")).cast("long")).cast("int"))


def mixing_rates(docs: DataFrame, targets: dict[str | None, float] | None = None, alpha: float = ALPHA, default: float | None = None) -> DataFrame:
    """(doc_id, source, lang, tokens, rate, copies) of every row of ``docs``.

    ``targets`` gives the weight of each source in tokens (the null source under ``None``), ``default`` that of sources
    without one; by default a source's target is its natural share to the power ``alpha``, normalized.
    """
    rows = _base(docs).select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("tokens").alias("__tokens"))
    out = _with_copies(rows, solve(_kinds(docs), targets, alpha, default))
    plain = lambda c: F.when(F.col(c) != "null", F.expr(f"substring(`{c}`, 2)"))
    return out.select(F.col("__doc").alias("doc_id"), plain("__source").alias("source"), plain("__lang").alias("lang"), F.col("__tokens").alias("tokens"), F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


def mix_sources(docs: DataFrame, targets: dict[str | None, float] | None = None, alpha: float = ALPHA, default: float | None = None) -> DataFrame:
    """``docs`` with each row repeated as often as its copies say; every row stays at least once."""
    balance = solve(_kinds(docs), targets, alpha, default)
    packed = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__doc"), _key(F.col("source")).alias("__source"), _key(F.col("lang")).alias("__lang"), token_count(F.col("text")).alias("__tokens"))
    return _with_copies(packed, balance).select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__i")).select("__row.*")
