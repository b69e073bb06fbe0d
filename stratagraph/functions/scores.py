"""Scoring expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..params import Coordinates, Policy, RankingConfig


def weighted(strategy: Column, confidence: Column, c: Coordinates = Coordinates()) -> Column:
    w = {"same_file": c.same_file, "type_hint": c.type_hint, "import": c.imports, "name_match": c.name_match, "lsp": c.lsp}
    out = F.lit(1.0)
    for name, weight in w.items():
        out = F.when(strategy == name, weight).otherwise(out)
    return confidence * out


def acceptance(confidence: Column, c: Coordinates = Coordinates()) -> Column:
    return 1 / (1 + F.exp(-c.slope * (confidence - c.bias)))


def accepted(confidence: Column, c: Coordinates = Coordinates()) -> Column:
    """acceptance > 0.5, without rounding at the threshold."""
    return confidence > c.bias


def recency(days: Column, c: RankingConfig = RankingConfig()) -> Column:
    return 1 + (c.recency_max - 1) * F.exp(-days / c.recency_decay_days)


def churn(commits: Column, c: RankingConfig = RankingConfig()) -> Column:
    return 1 + F.log(1 + F.greatest(commits - c.churn_threshold, F.lit(0))) * (c.churn_max - 1) / 5


def phase(last_days: Column, first_days: Column, commits: Column, c: RankingConfig = RankingConfig()) -> Column:
    """Old and quiet, new, old but busy, or neither; in this order."""
    return (
        F.when((first_days >= c.crystal_age_days) & (last_days >= c.crystal_quiet_days), "crystal")
        .when(first_days <= c.emergent_age_days, "emergent")
        .when((first_days >= c.rotting_age_days) & (last_days <= c.rotting_quiet_days) & (commits >= c.badge_churn_commits), "rotting")
        .otherwise("evolving")
    )


def badges(last_days: Column, commits: Column, phase: Column, c: RankingConfig = RankingConfig()) -> Column:
    return F.array_compact(F.array(F.when(last_days <= c.badge_recent_days, "recent"), F.when(commits >= c.badge_churn_commits, "high-churn"), phase))


def site_score(centrality: Column, percentile: Column, confidence: Column, coherence: Column, is_root: Column, bridge: Column, p: Policy = Policy()) -> Column:
    clamp = lambda x: min(1.0, max(0.0, x))
    n, m = clamp(p.normalisation), clamp(p.mixing)
    central = (1 - n) * centrality + n * F.coalesce(percentile, centrality)
    ln = lambda x, floor: F.greatest(F.when(x > 0, F.log(x)), F.lit(floor))
    tiny = math.log(1e-10)
    additive = p.weight_centrality * ln(central, -10.0) + p.weight_uncertainty * (1 - confidence) + p.weight_coherence * F.log1p(coherence) + p.weight_causality * is_root.cast("double") + p.weight_bridge * F.log1p(bridge)
    product = p.weight_centrality * ln(central, tiny) + p.weight_uncertainty * ln(1 - confidence, tiny) + p.weight_coherence * F.log1p(coherence) + p.weight_bridge * F.log1p(bridge) - p.weight_causality * (~is_root).cast("double")
    return (1 - m) * additive + m * product


def boltzmann(score: Column, p: Policy = Policy()) -> Column:
    return F.exp(score / max(p.temperature, 0.01))


def should_continue(rate: float, wave: int, p: Policy = Policy()) -> bool:
    decay = (0.9 - 0.6 * min(1.0, max(0.0, p.latency_bias))) ** wave
    return rate >= p.utility_floor and rate >= p.utility_floor / max(decay, 0.01)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(logits, lambda x: F.exp(x - top) / total)


def decode(x: Column, least: Column, most: Column, logarithmic: Column) -> Column:
    return F.when(logarithmic, F.exp(F.log(least) + x * (F.log(most) - F.log(least)))).otherwise(least + x * (most - least))


def encode(v: Column, least: Column, most: Column, logarithmic: Column) -> Column:
    return F.when(logarithmic, (F.log(v) - F.log(least)) / (F.log(most) - F.log(least))).otherwise((v - least) / (most - least))


def meta_levers(p: dict[str, Column]) -> dict[str, Column]:
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return {
        "structural_trust": unit(p["pagerank_alpha"]),
        "temporal_horizon": 1 - unit(30 / F.greatest(p["git_recency_decay_days"], F.lit(1.0))),
        "exploration_bias": F.lit(0.5),
        "depth_sensitivity": unit(p["depth_weight_root"] / F.greatest(p["depth_weight_deep"], F.lit(0.01)) / 100),
        "hub_damping": 1 - unit(p["pagerank_chat_multiplier"] / 200),
        "focus_locality": unit((1 - p["focus_decay"]) * (1 - p["focus_max_hops"] / 5)),
    }


def alerts(degree: Column, utilisation: Column, correlation: Column, latency_ms: Column) -> Column:
    return F.array_compact(F.array(
        F.when(degree < 1, "shadow_collapse").when(degree < 2, "low_connectivity"),
        F.when(utilisation < 0.3, "low_utilisation").when(utilisation < 0.5, "moderate_utilisation"),
        F.when(correlation < 0.3, "severe_rank_divergence").when(correlation < 0.5, "rank_divergence"),
        F.when(latency_ms > 10000, "high_latency"),
    ))


def change_factor(direction: Column, magnitude: Column) -> Column:
    """Large steps double or zero; medium and unknown ones move by three tenths, small ones by one."""
    step = F.when(magnitude == "large", 1.0).when(magnitude == "small", 0.1).otherwise(0.3)
    return F.when(direction == "increase", 1 + step).otherwise(1 - step)


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on an integer key and a seed alone, by arithmetic that any engine repeats."""
    h = F.pmod(F.pmod(key.cast("bigint"), F.lit(2147483648)) * 1103515245 + 12345 + 7919 * seed, F.lit(2147483648))
    h = F.pmod(h * 1103515245 + 12345, F.lit(2147483648))
    return h / 2147483648.0
