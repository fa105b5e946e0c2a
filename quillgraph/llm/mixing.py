"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A classifier fitted on the labels table gives each document a posterior over domains (low quality, toxic,
clean). Documents then get nonnegative rates whose expected domain tokens, sum over documents of rate x tokens
x posterior, match targets in the least-squares sense, with the domain masses m (the totals at rate 1) as weights of
the squares and the token counts as the metric. Proximal steps from rate 1 find them:
    rate <- clip(rate - sum_k p_k s_k),   s_k = (total_k - target_k) / (PROX m_k) at the new rates,
where s solves K smooth equations that Newton steps with K x K systems find. One pass is one sum over
all documents; only its sums of K and K x K values reach the driver, and a document's rate is a function of its
posterior and the few steps' K values, so rates need no state and no join. The fit ends when every total is at its
target, or, for targets that can't be met, when the duality gap bounds each total's distance from the least-squares
solution; it raises if neither is reached.

The classifier is a naive Bayes model over hashed words (``BUCKETS`` features), fitted on at most
``PER_LABEL`` labelled documents for each label; its log odds are averaged over the words and weighed as
``WEIGHT`` words, which keeps memberships soft.

Defined results: null text has no words, the prior as posterior, zero tokens and rate 1; domains without mass
are left out of the fit (their target can't be reached); without labels all documents share one posterior;
repeated rows count each, and have one rate; labels that contradict each other put a document in each of their
domains, labels with a null count for none; an empty table gives no rows; other columns are passed on untouched.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import labelled_sample, materialize

DOMAINS = ("low", "toxic", "clean")
BUCKETS = 4096
PER_LABEL = 5000
WEIGHT = 48
#: Weight of staying at the rates of the step before; it sets the number of steps, not where they lead.
PROX = 1e-3
#: Passes over the documents after which a fit without result raises.
ROUNDS = 400
#: Share of its target by which a total may miss it.
TOLERANCE = 1e-6
#: Share of its target by which a total may miss the least-squares solution, by a bound that is seldom tight.
BOUND = 1e-3
#: Unlimited rates are compared with rates of up to this in that bound.
WIDE = 100.0
#: A domain with a smaller share of all tokens is without mass: sums of doubles can't hold it beside the others.
LEAST = 1e-9
#: Rows that go which are broadcast (16 bytes each); beside more, documents are shuffled.
BROADCAST_ROWS = 300_000
#: Reductions, by 4, of a Newton step; what is reached then is taken as the next step.
CUTS = 8
SHARES = {"low": 0.05, "toxic": 0.05, "clean": 0.90}


def words(documents: DataFrame, *columns) -> DataFrame:
    """(columns, word): the lower-cased words of ``text`` without commas and full stops; a text without words gives one empty word."""
    plain = F.translate(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "\n\t\r.,;", "   ")
    return documents.select(*columns, F.explode_outer(F.split(plain, " ")).alias("word"))


def bucket() -> F.Column:
    """A word's feature."""
    return F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")


class DomainModel:
    """Log odds of each domain against the last one, by word bucket."""

    def __init__(self, prior: dict[str, float], odds: dict[str, list[float]]):
        self.prior, self.odds = prior, odds

    @classmethod
    def fit(cls, documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DomainModel:
        own = labels.where("quality is not null and toxic is not null")
        kind = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").otherwise("clean")
        named = own.select("doc_id", kind.alias("domain"))
        counts = {r[0]: r[1] for r in named.groupBy("domain").count().collect()}
        total = sum(counts.values())
        prior = {d: math.log((counts.get(d, 0) + 1) / (total + len(DOMAINS))) for d in DOMAINS}
        rows = None
        for d in DOMAINS:
            part = labelled_sample(documents, named.where(F.col("domain") == d).withColumn("one", F.lit(1)), "one", per_label)
            part = words(part, F.lit(d).alias("domain")).where("word <> ''").select("domain", bucket().alias("bucket"))
            rows = part if rows is None else rows.unionByName(part)
        held = rows.groupBy("domain", "bucket").count().collect()  # at most BUCKETS for each domain
        seen = {d: [0.5] * BUCKETS for d in DOMAINS}
        for r in held:
            seen[r["domain"]][r["bucket"]] += r["count"]
        log = {d: [math.log(x / sum(c)) for x in c] for d, c in seen.items()}
        base = log[DOMAINS[-1]]
        return cls(prior, {d: [round(x - y, 4) for x, y in zip(log[d], base, strict=True)] for d in DOMAINS[:-1]})

    def members(self, documents: DataFrame) -> DataFrame:
        """(doc_id, _of, _tokens, _p_<domain>) per row of ``documents``, materialised; _of is a hash of the text.

        Words are looked up in the model's tables as they are split and summed before anything is shuffled.
        """
        rows = documents.select("doc_id", "text", F.xxhash64("text").alias("_of"), F.monotonically_increasing_id().alias("_row"))
        said = words(rows, "_row", "doc_id", "_of").withColumn("_b", F.when(F.col("word") != "", bucket()))
        table = {d: F.expr(f"array({','.join(f'{x}D' for x in self.odds[d])})") for d in DOMAINS[:-1]}
        sums = said.groupBy("_row", "doc_id", "_of").agg(F.count("_b").cast("double").alias("_tokens"), *(F.sum(F.get(table[d], F.col("_b"))).alias(f"_s_{d}") for d in DOMAINS[:-1]))
        base = self.prior[DOMAINS[-1]]
        for d in DOMAINS[:-1]:
            mean = F.coalesce(F.col(f"_s_{d}") / F.nullif("_tokens", F.lit(0.0)), F.lit(0.0))
            z = F.lit(self.prior[d] - base) + mean * F.least("_tokens", F.lit(float(WEIGHT)))
            sums = sums.withColumn(f"_e_{d}", F.exp(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), z))))
        whole = sum((F.col(f"_e_{d}") for d in DOMAINS[:-1]), F.lit(1.0))
        posterior = [((F.col(f"_e_{d}") if d != DOMAINS[-1] else F.lit(1.0)) / whole).alias(f"_p_{d}") for d in DOMAINS]
        return materialize(sums.select("doc_id", "_of", "_tokens", *posterior))


def rate(steps: list[dict[str, float]], most: float | None = None) -> F.Column:
    """A document's rate after the steps, from 1."""
    if not steps:
        return F.lit(1.0)
    table = F.array(*(F.array(*(F.lit(float(step.get(d, 0.0))) for d in DOMAINS)) for step in steps))
    most = math.inf if most is None else most

    def round_of(w: F.Column, step: F.Column) -> F.Column:
        moved = w - sum((F.col(f"_p_{d}") * step[i] for i, d in enumerate(DOMAINS)), F.lit(0.0))
        return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), moved))

    return F.when(F.col("_tokens") > 0, F.aggregate(table, F.lit(1.0), round_of)).otherwise(1.0)


def fit_rates(members: DataFrame, targets, most: float | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE, domains: tuple[str, ...] = DOMAINS) -> list[dict[str, float]]:
    """The steps that lead to the targets. ``targets`` maps the domain masses to target totals, of which those of ``domains`` count; ``members`` is materialised (_tokens, _p_*)."""
    masses = members.agg(*(F.sum(F.col("_tokens") * F.col(f"_p_{d}")).alias(d) for d in DOMAINS)).first().asDict()
    live = [d for d in domains if (masses[d] or 0) > LEAST * sum(m or 0 for m in masses.values())]
    goal = targets({d: masses[d] or 0.0 for d in DOMAINS})
    mass, aim = np.array([masses[d] for d in live]), np.array([goal[d] for d in live])
    own = np.where(aim > 0, aim, mass)
    steps: list[dict[str, float]] = []
    passes = 0
    while live:
        totals, off = _distance(members, steps, most, live, mass, aim)
        passes += 1
        if (np.abs(totals - aim) <= tolerance * own).all() or (off <= BOUND * own).all():
            break
        at, cuts = np.zeros(len(live)), 0
        value, slope, curve = _dual(members, steps, most, live, mass, aim, at)
        step = np.linalg.solve(curve, -slope)
        passes += 1
        while cuts <= CUTS and (np.abs(slope) > tolerance / 10 * own).any():
            if passes >= rounds:
                raise RuntimeError(f"rates did not settle in {rounds} passes")
            tried = _dual(members, steps, most, live, mass, aim, at + step)
            passes += 1
            if tried[0] <= value + 1e-4 * float(slope @ step) or np.abs(tried[1] / own).max() < 0.5 * np.abs(slope / own).max():
                at, (value, slope, curve), cuts = at + step, tried, 0
                step = np.linalg.solve(curve, -slope)
            else:
                step, cuts = step / 4, cuts + 1
        if passes >= rounds:
            raise RuntimeError(f"rates did not settle in {rounds} passes")
        steps.append(dict(zip(live, at.tolist(), strict=True)))
    return steps


def _clipped(z: F.Column, most: float | None) -> F.Column:
    return F.least(F.lit(math.inf if most is None else float(most)), F.greatest(F.lit(0.0), z))


def _weighed(values: np.ndarray, live: list[str]) -> F.Column:
    return sum((F.col(f"_p_{d}") * float(v) for d, v in zip(live, values, strict=True)), F.lit(0.0))


def _distance(members: DataFrame, steps: list[dict[str, float]], most: float | None, live: list[str], mass: np.ndarray, aim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The totals, and by domain a bound of their distance from the least-squares solution (the root of twice the duality gap)."""
    rated = members.where("_tokens > 0").withColumn("_w", rate(steps, most))
    totals = np.array(rated.agg(*(F.sum(F.col("_w") * F.col("_tokens") * F.col(f"_p_{d}")) for d in live)).first(), float)
    slope = _weighed((totals - aim) / mass, live)
    room = F.lit(WIDE if most is None else float(most)) - F.col("_w")
    gap = rated.agg(F.sum(F.col("_tokens") * F.when(slope > 0, slope * F.col("_w")).otherwise(-slope * F.greatest(F.lit(0.0), room)))).first()[0]
    return totals, np.sqrt(2 * max(gap, 0.0) * mass)


def _dual(members: DataFrame, steps: list[dict[str, float]], most: float | None, live: list[str], mass: np.ndarray, aim: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, slope and curvature at ``at`` of the convex function whose minimum is the next step."""
    rated = members.where("_tokens > 0").withColumn("_z", rate(steps, most) - _weighed(at, live)).withColumn("_w", _clipped(F.col("_z"), most))
    inner = F.when(F.col("_z") == F.col("_w"), F.col("_tokens")).otherwise(0.0)
    pairs = [(i, j) for i in range(len(live)) for j in range(i + 1)]
    p = [F.col(f"_p_{d}") for d in live]
    row = rated.agg(
        F.sum(F.col("_tokens") * (F.col("_z") * F.col("_w") - F.col("_w") * F.col("_w") / 2)),
        *(F.sum(F.col("_tokens") * F.col("_w") * c) for c in p),
        *(F.sum(inner * p[i] * p[j]) for i, j in pairs),
    ).first()
    k = len(live)
    curve = np.diag(PROX * mass)
    for (i, j), v in zip(pairs, row[1 + k :], strict=True):
        curve[i, j] += v
        curve[j, i] = curve[i, j]
    return row[0] + float(at @ aim) + PROX / 2 * float(mass @ at**2), aim + PROX * mass * at - np.array(row[1 : 1 + k], float), curve


def by_shares(shares: dict[str, float] = SHARES):
    """Targets: the present number of tokens, shared out anew."""
    return lambda masses: {d: shares[d] * sum(masses.values()) for d in masses}


def by_factors(factors: dict[str, float]):
    """Targets: each domain's present tokens times a factor."""
    return lambda masses: {d: factors[d] * m for d, m in masses.items()}


def mix(documents: DataFrame, labels: DataFrame, targets=None, most: float | None = None) -> DataFrame:
    """(doc_id, n_words, p_low, p_toxic, p_clean, rate) per row of ``documents``."""
    members = DomainModel.fit(documents, labels).members(documents)
    steps = fit_rates(members, targets or by_shares(), most)
    return members.select("doc_id", F.col("_tokens").cast("long").alias("n_words"), *(F.col(f"_p_{d}").alias(f"p_{d}") for d in DOMAINS), rate(steps, most).alias("rate"))


def thinned(members: DataFrame, factors: dict[str, float]) -> tuple[F.Column, F.Column]:
    """Whether a document may go, and its rate.

    A document belongs to the domain of its largest posterior, the later of equals. Documents of a domain with a
    factor of 1 or more stay. Over the others, rates of 1 or less bring the totals of the remaining domains to
    their factors; what these documents hold of the kept domains has no target.
    """
    cut = tuple(d for d in DOMAINS if factors[d] < 1)
    largest = F.greatest(*(F.col(f"_p_{d}") for d in DOMAINS))
    own = F.coalesce(*(F.when(F.col(f"_p_{d}") == largest, d) for d in reversed(DOMAINS)))
    free = own.isin(*cut) & (F.col("_tokens") > 0)
    steps = fit_rates(members.where(free), by_factors(factors), most=1.0, domains=cut)
    return free, F.when(free, rate(steps, 1.0)).otherwise(1.0)


def thin(documents: DataFrame, labels: DataFrame, factors: dict[str, float]) -> DataFrame:
    """The rows of ``documents`` that stay when domains are thinned by ``factors``: a row stays with its rate as probability, drawn by a hash of the row."""
    members = DomainModel.fit(documents, labels).members(documents)
    free, share = thinned(members, factors)
    draw = F.pmod(F.xxhash64("doc_id", "_of", F.lit("mixing")), F.lit(1 << 40)) / float(1 << 40)
    gone = materialize(members.where(free & (draw >= share)).select(F.col("doc_id").alias("__qg_id"), F.col("_of").alias("__qg_gone")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone  # documents stay where they are beside few
    same = documents["doc_id"].eqNullSafe(F.col("__qg_id")) & F.xxhash64(documents["text"]).eqNullSafe(F.col("__qg_gone"))
    return documents.join(gone, same, "left_anti")
