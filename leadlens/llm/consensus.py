"""Problem 5: consensus of annotators who disagree.

Method: the community confusion model. Every annotator belongs to one of a few types; a type has a
confusion matrix shared by all its annotators, so an annotator with few labels leans on the type
rather than on noise of their own. Types, matrices and true classes are found by variational
updates. True classes are "like" and one class per reason of a pass; a pass without a known reason
is evidence for any pass.

All steps are joins and aggregations inside the JVM. The driver sees only numbers per
(type, class, label), whose count is fixed. Votes are clustered by item once, so that the sums per
item are nearly done map-side; a round writes the expected counts of every annotator and label, from
which types and totals follow. Rounds end when the matrices stand still.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.session import materialise, release
from leadlens.streaming.changes import clean_action, pack_id, unpack_id

# The reasons a pass may have.
REASONS = ("bad_evidence", "hard_to_execute", "low_margin", "too_ordinary", "weak_function", "wrong_category")
#: Types to begin with: share of right verdicts on likes, on passes, and of right reasons among right passes.
TYPES = {
    "careful": (0.9, 0.85, 0.85),
    "fair": (0.75, 0.65, 0.6),
    "lenient": (0.93, 0.4, 0.55),
    "random": (0.5, 0.5, 1 / 6),
    "always likes": (0.97, 0.03, 1 / 6),
    "always passes": (0.03, 0.97, 1 / 6),
    "contrary": (0.3, 0.3, 1 / 6),
}
#: Pseudo-counts that tie a matrix to its beginning.
PRIOR = 40.0
#: Most rounds, and the largest change of a mean confusion or class share at which they end.
ROUNDS, STILL = 20, 0.004


def _digamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for _ in range(6):
        shift -= 1 / x
        x = x + 1
    return shift + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def _beginning(types: dict[str, tuple[float, float, float]], n: int) -> np.ndarray:
    """Mean confusion matrices [type, true class, label] for ``n`` reasons."""
    out = np.zeros((len(types), n + 1, n + 1))
    for m, (like, rejected, reason) in enumerate(types.values()):
        out[m, 0, 0] = like
        out[m, 0, 1:] = (1 - like) / n
        out[m, 1:, 0] = 1 - rejected
        for k in range(1, n + 1):
            out[m, k, 1:] = rejected * (1 - reason) / max(1, n - 1)
            out[m, k, k] = rejected * reason
    return out


def _alike(counts: np.ndarray) -> np.ndarray:
    """Counts with the reasons treated alike: one share for the right reason, one for every other."""
    out, n = counts.copy(), counts.shape[1] - 1
    out[:, 0, 1:] = counts[:, 0, 1:].mean(axis=1, keepdims=True)
    out[:, 1:, 0] = counts[:, 1:, 0].mean(axis=1, keepdims=True)
    inner = counts[:, 1:, 1:]
    right = np.trace(inner, axis1=1, axis2=2)
    out[:, 1:, 1:] = ((inner.sum(axis=(1, 2)) - right) / max(1, n * (n - 1)))[:, None, None]
    for k in range(1, n + 1):
        out[:, k, k] = right / n
    return out


def _expected_logs(counts: np.ndarray) -> np.ndarray:
    """E[log confusion] as [label, type, class], the bare pass included."""
    logs = _digamma(counts) - _digamma(counts.sum(axis=2, keepdims=True))
    bare = np.log(np.exp(logs[:, :, 1:]).sum(axis=2, keepdims=True))
    return np.concatenate([logs, bare], axis=2).transpose(2, 0, 1)


# Expressions over all types and classes are written as SQL text: building them column by column takes the driver longer than running them.


def _softmax(names: list[str]) -> dict[str, Column]:
    top = f"greatest({', '.join(names)})"
    whole = " + ".join(f"exp({n} - {top})" for n in names)
    return {n: F.expr(f"cast(exp({n} - {top}) / ({whole}) as float)") for n in names}


def _figure(figures: list[float], i: int, count: Column) -> Column:
    """One of several figures, looked up with the help of a count of one or more: as a constant it would make Spark compile each round's code anew."""
    return F.element_at(F.lit(figures), F.least(count, F.lit(1)).cast("int") + i)


def label_of(action: Column, reason: Column, reasons: tuple[str, ...] = REASONS) -> Column:
    """0 for a like, 1 and up for a pass with a known reason, one more than the reasons for another pass; null for anything else."""
    spelled = F.regexp_replace(F.lower(F.trim(reason)), r"[\s\p{Z}\-_]+", "_")
    out = F.when(clean_action(action) == "like", 0)
    for k, code in enumerate(reasons, 1):
        out = out.when((clean_action(action) == "pass") & (spelled == code), k)
    return out.when(clean_action(action) == "pass", len(reasons) + 1).cast("tinyint")


class Consensus:
    """The fitted model: ``items`` and ``annotators`` give its results."""

    def __init__(
        self, votes: DataFrame, annotator: str, item: str, action: str, reason: str,
        reasons: tuple[str, ...] = REASONS, types: dict[str, tuple[float, float, float]] | None = None, prior: float = PRIOR, rounds: int = ROUNDS, still: float = STILL,
    ):
        """``votes`` holds at most one vote per annotator and item; rows with null keys or another action are left out.

        ``reasons`` are the codes a pass may have, ``types`` the beginnings of the annotator types and ``prior`` how firmly they hold.
        """
        coded = votes.select(
            pack_id(F.col(annotator).cast("string")).alias("actor"), pack_id(F.col(item).cast("string")).alias("item"), label_of(F.col(action), F.col(reason), reasons).alias("label")
        ).where("actor is not null and item is not null and label is not null")
        self.votes = materialise(coded.hint("rebalance", "item").sortWithinPartitions("item"), "votes")
        self.reasons, self.names = reasons, types or TYPES
        self.m, self.k = len(self.names), len(reasons) + 1
        self.qs, self.ps = [f"q{i}" for i in range(self.m)], [f"p{i}" for i in range(self.k)]
        begin = _beginning(self.names, len(reasons))
        counts, self.shares = prior * begin, np.full(self.m, 1 / self.m)
        self.prior = np.full(self.k, 0.5 / (self.k - 1))
        self.prior[0] = 0.5
        self.mean, self.logs = begin, _expected_logs(counts)
        self.types: DataFrame | None = None
        stats: DataFrame | None = None
        self.rounds = 0
        while self.rounds < rounds:
            before, stats = stats, materialise(self._stats(self.posterior()), "stats")
            self.types = self._types(stats)
            sums = self._sums(stats)
            release(*[before] * (before is not None))
            counts = prior * begin + _alike(sums["matrix"])
            mean = counts / counts.sum(axis=2, keepdims=True)
            moved = max(np.abs(mean - self.mean).max(), np.abs(sums["prior"] - self.prior).max())
            self.shares, self.prior, self.mean = sums["shares"], sums["prior"], mean
            self.rounds += 1
            if moved < still:
                break
            self.logs = _expected_logs(counts)
        # types as the last round left them, by the figures of that round
        self.types = materialise(self.types, "types") if self.types is not None else None
        self.logs = _expected_logs(counts)
        release(*[stats] * (stats is not None))

    def _looked_up(self) -> Column:
        return F.element_at(F.lit(self.logs.reshape(self.k + 1, -1).tolist()), F.col("label") + 1)

    def posterior(self) -> DataFrame:
        """``(item, votes, passes, seen, p0, p1, ...)``: class probabilities of every item."""
        if self.types is None:
            voted = self.votes.withColumns({q: F.lit(float(s)) for q, s in zip(self.qs, self.shares)})
        else:
            voted = self.votes.join(self.types, "actor")
        voted = voted.withColumn("_l", self._looked_up())
        evidence = [F.expr(f"sum({' + '.join(f'{q} * _l[{m * self.k + k}]' for m, q in enumerate(self.qs))})").alias(p) for k, p in enumerate(self.ps)]
        grouped = voted.groupBy("item").agg(
            *evidence,
            F.count(F.lit(1)).alias("votes"),
            F.count_if(F.col("label") > 0).alias("passes"),
            F.bit_or(F.expr("shiftleft(1L, cast(label as int))")).alias("seen"),
        )
        with_prior = {p: F.col(p) + _figure([math.log(max(x, 1e-9)) for x in self.prior], k, F.col("votes")) for k, p in enumerate(self.ps)}
        return grouped.withColumns(with_prior).withColumns(_softmax(self.ps))

    def _stats(self, posterior: DataFrame) -> DataFrame:
        """Expected class counts of every annotator and label."""
        return self.votes.join(posterior.select("item", *self.ps), "item").groupBy("actor", "label").agg(*[F.sum(p).alias(p) for p in self.ps])

    def _types(self, stats: DataFrame) -> DataFrame:
        """Type probabilities of every annotator, and its number of labels."""
        looked = stats.withColumn("_l", self._looked_up())
        scores = [F.expr(f"sum({' + '.join(f'{p} * _l[{m * self.k + k}]' for k, p in enumerate(self.ps))})").alias(q) for m, q in enumerate(self.qs)]
        shares = {q: F.col(q) + _figure([math.log(max(x, 1e-9)) for x in self.shares], m, F.col("labels")) for m, q in enumerate(self.qs)}
        return looked.groupBy("actor").agg(*scores, F.count(F.lit(1)).alias("labels")).withColumns(shares).withColumns(_softmax(self.qs))

    def _sums(self, stats: DataFrame) -> dict[str, np.ndarray]:
        """Counts per (type, class, label), type shares and class shares: a fixed number of figures."""
        cells = [F.expr(f"sum({q} * {p}) as {q}{p}") for q in self.qs for p in self.ps]
        each = [F.expr(f"sum({q} / labels) as {q}") for q in self.qs]  # an annotator counts once over its labels
        matrix, prior, typed = np.zeros((self.m, self.k, self.k)), np.array([self.k - 1.0] + [1.0] * (self.k - 1)), np.ones(self.m)
        for row in stats.join(self.types, "actor").groupBy("label").agg(*cells, *each).collect():
            got = np.array([row[f"{q}{p}"] for q in self.qs for p in self.ps]).reshape(self.m, self.k)
            prior += got.sum(axis=0)
            typed += np.array([row[q] for q in self.qs])
            if row["label"] < self.k:
                matrix[:, :, row["label"]] += got
            else:  # a bare pass spreads over the reasons as the type gives them
                spread = np.exp(self.logs[1 : self.k].transpose(1, 2, 0))
                matrix[:, :, 1:] += got[:, :, None] * spread / spread.sum(axis=2, keepdims=True)
        return {"matrix": matrix, "prior": prior / prior.sum(), "shares": typed / typed.sum()}

    def items(self) -> DataFrame:
        """``(item, votes, verdict, reason, confidence, agreement)`` of every item with a vote.

        The verdict is "pass" if the pass classes together outweigh "like". The reason is the
        likeliest of those that some vote gave, null where none gave a known one. ``agreement`` is
        the share of votes with the verdict. Ties go to "like" and to the first code.
        """
        passed = F.expr(" + ".join(f"cast({p} as double)" for p in self.ps[1:]))
        best = F.array_max(
            F.array(*[F.when(F.col("seen").bitwiseAND(F.lit(1 << k)) != 0, F.struct(F.col(self.ps[k]).alias("p"), F.lit(-k).alias("k"))) for k in range(1, self.k)])
        )
        known = F.lit(sum(1 << k for k in range(1, self.k))).cast("long")
        named = F.when(F.col("seen").bitwiseAND(known) != 0, F.element_at(F.array(*[F.lit(r) for r in self.reasons]), -best["k"]))
        verdict = F.when(F.col("_pass") > F.col("p0"), "pass").otherwise("like")
        return (
            self.posterior().withColumn("_pass", passed).withColumn("verdict", verdict)
            .select(
                unpack_id(F.col("item")).alias("item"), "votes", "verdict", F.when(F.col("verdict") == "pass", named).alias("reason"),
                F.least(F.greatest("_pass", F.col("p0").cast("double")), F.lit(1.0)).alias("confidence"),
                (F.when(F.col("verdict") == "pass", F.col("passes")).otherwise(F.col("votes") - F.col("passes")) / F.col("votes")).alias("agreement"),
            )
        )

    def annotators(self) -> DataFrame:
        """``(annotator, kind, trust)``: the likeliest type and the expected share of right verdicts."""
        right = [0.5 * self.mean[m, 0, 0] + 0.5 * self.mean[m, 1:, 1:].sum(axis=1).mean() for m in range(self.m)]
        kind = F.array_max(F.array(*[F.struct(F.col(q).alias("q"), F.lit(-m).alias("m")) for m, q in enumerate(self.qs)]))["m"]
        return self.types.select(
            unpack_id(F.col("actor")).alias("annotator"),
            F.element_at(F.array(*[F.lit(t) for t in self.names]), 1 - kind).alias("kind"),
            F.expr(" + ".join(f"{q} * {float(right[m])!r}D" for m, q in enumerate(self.qs))).cast("double").alias("trust"),
        )
