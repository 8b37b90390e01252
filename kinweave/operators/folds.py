"""Training and tuning over cases: labelled matrices, folds, thresholds, the objective of a trial, reports."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from math import exp, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolution import LEAST_GAP

METRICS = ["ari", "nmi", *(f"{kind}_{m}" for kind in ("bcubed", "pairwise") for m in ("precision", "recall", "f1", "f0_5"))]
RECALL_LEAST, FAILED = 0.70, -1.0
KEYS = ["run_id", "entity_id_a", "entity_id_b"]


@dataclass(frozen=True)
class Fold:
    name: str
    train: tuple[str, ...]
    held_out: str


@dataclass
class Plan:
    folds: list[Fold]
    final_test: str | None = None
    cases: tuple[str, ...] = field(default_factory=tuple)


def read_plan(payload: dict) -> Plan:
    """Folds from a config; raises on unknown cases, repeated training cases, held-out ones in training, and test overlap."""
    cases = tuple(c["name"] if isinstance(c, dict) else c for c in payload.get("cases", []))
    if not cases or len(set(cases)) < len(cases):
        raise ValueError("cases must be named once each")
    final, folds = payload.get("final_test"), []
    if final is not None and final not in cases:
        raise ValueError(f"unknown case {final}")
    for i, f in enumerate(payload.get("folds", [])):
        name, train, held = f.get("name") or f"fold_{i + 1}", tuple(f["train"]), f["held_out"]
        if unknown := {*train, held} - set(cases):
            raise ValueError(f"{name}: unknown cases {sorted(unknown)}")
        if len(set(train)) < len(train):
            raise ValueError(f"{name}: a training case is repeated")
        if not train or held in train:
            raise ValueError(f"{name}: the held-out case must not be trained on, and something must be")
        if final in {*train, held}:
            raise ValueError(f"{name}: the final test case must stay out")
        folds.append(Fold(name, train, held))
    if not folds or len({f.name for f in folds}) < len(folds):
        raise ValueError("folds must be there and named once each")
    return Plan(folds, final, cases)


def labelled_matrix(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of the labelled pairs. A repeated key in either table, or a label without features, raises when the plan runs."""
    f = features.join(features.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_nf")), KEYS)
    n = labels.groupBy(*KEYS).agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("_nl"))
    both = n.join(f, KEYS, "left")
    wrong = F.when(F.col("_nf").isNull(), F.lit("a label has no features")).when((F.col("_nf") > 1) | (F.col("_nl") > 1), F.lit("a pair is repeated"))
    return both.where(F.when(wrong.isNull(), True).otherwise(F.raise_error(wrong).cast("boolean"))).drop("_nf", "_nl")


def run_statistics(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("label").cast("bigint")).alias("n_positive"), F.round(F.avg(F.col("label").cast("double")), 6).alias("positive_rate"))


def draw_thresholds(rng: random.Random) -> tuple[float, float]:
    """keep from 0.45 to 0.75 and neutral from max(0.65, keep + LEAST_GAP) to 0.90, in steps of 0.01."""
    keep = rng.randint(45, 75)
    return keep / 100, rng.randint(max(65, keep + round(100 * LEAST_GAP)), 90) / 100


def geometric_mean(values: list[float]) -> float:
    """0 for none, or if one isn't positive."""
    return 0.0 if not values or min(values) <= 0 else exp(sum(map(log, values)) / len(values))


def fingerprint(plan: Plan, **more) -> str:
    """Names what a study depends on, so that trials of different inputs aren't mixed."""
    text = json.dumps([[f.name, f.train, f.held_out] for f in plan.folds] + [plan.final_test, sorted(more.items())], default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


FoldRunner = Callable[[Fold, dict, float, float], dict[str, float]]


def run_trial(plan: Plan, runner: FoldRunner, params: dict, keep: float, neutral: float) -> dict:
    """Metrics of each fold, their mean, the geometric mean of pairwise F0.5, and whether every fold keeps its recall.

    A fold that raises fails the trial: its objective is FAILED.
    """
    rows, error = [], None
    for fold in plan.folds:
        try:
            rows.append({"fold": fold.name} | runner(fold, params, keep, neutral))
        except Exception as e:
            error = f"{fold.name}: {type(e).__name__}: {e}"[:300]
            break
    good = error is None
    mean = {m: sum(r[m] for r in rows) / len(rows) for m in METRICS if rows and all(m in r for r in rows)} if good else {}
    return {
        "params": params, "keep": keep, "neutral": neutral, "folds": rows, "mean": mean, "error": error, "trusted": good and all(r["pairwise_recall"] >= RECALL_LEAST for r in rows),
        "objective": geometric_mean([r["pairwise_f0_5"] for r in rows]) if good else FAILED,
    }


def run_study(plan: Plan, runner: FoldRunner, draw_params: Callable[[random.Random], dict], trials: int, seed: int = 7, known: dict | None = None, **inputs) -> dict:
    """Seeded trials; the best trusted one is run on the final test case. known: an earlier study to go on with, of equal inputs."""
    mark = fingerprint(plan, **inputs)
    if known and known["fingerprint"] != mark:
        raise ValueError("the study was begun on other inputs")
    rng, done = random.Random(seed), list(known["trials"]) if known else []
    for number in range(trials):
        params, thresholds = draw_params(rng), draw_thresholds(rng)
        if number >= len(done):
            done.append({"number": number} | run_trial(plan, runner, params, *thresholds))
    best = max((t for t in done if t["trusted"]), key=lambda t: t["objective"], default=None)
    final = None
    if best and plan.final_test:
        final = runner(Fold("final", tuple(c for c in plan.cases if c != plan.final_test), plan.final_test), best["params"], best["keep"], best["neutral"])
    return {"fingerprint": mark, "seed": seed, "trials": done, "best": best, "final_test": final, "n_trusted": sum(t["trusted"] for t in done)}


def reading(mean: dict[str, float]) -> str:
    """What a summary's recall and precision say."""
    p, r = mean.get("pairwise_precision", 0.0), mean.get("pairwise_recall", 0.0)
    if p >= 0.9:
        return "precise and complete" if r >= RECALL_LEAST else "precise, but misses merges"
    return "complete, but merges too much" if r >= RECALL_LEAST else "neither precise nor complete"
