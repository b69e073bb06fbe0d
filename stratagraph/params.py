"""Parameters that define the semantics, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

VENDOR = ("node_modules", "vendor", "third_party", "__pycache__", "site-packages", ".git", "target")


@dataclass(frozen=True)
class RankingConfig:
    alpha: float = 0.85
    chat_multiplier: float = 100.0
    epsilon: float = 1e-8
    max_iterations: int = 100
    depth_root: float = 1.0
    depth_moderate: float = 0.5
    depth_deep: float = 0.1
    depth_vendor: float = 0.01
    root_slashes: int = 2
    moderate_slashes: int = 4
    vendor: tuple[str, ...] = VENDOR
    boost_ident: float = 10.0
    boost_file: float = 5.0
    boost_chat: float = 20.0
    boost_temporal: float = 3.0
    boost_focus: float = 5.0
    boost_caller: float = 2.0
    hub_damping: float = 0.0
    focus_hops: int = 2
    focus_decay: float = 0.5
    recency_decay_days: float = 30.0
    recency_max: float = 10.0
    churn_threshold: int = 5
    churn_max: float = 6.0
    badge_recent_days: int = 7
    badge_churn_commits: int = 10
    crystal_age_days: int = 180
    crystal_quiet_days: int = 30
    emergent_age_days: int = 30
    rotting_age_days: int = 90
    rotting_quiet_days: int = 14


@dataclass(frozen=True)
class Coordinates:
    """Weights of the resolution strategies and the acceptance gate."""

    same_file: float = 1.0
    type_hint: float = 1.0
    imports: float = 1.0
    name_match: float = 1.0
    lsp: float = 1.0
    bias: float = 0.3
    slope: float = 10.0

    @staticmethod
    def shadow() -> Coordinates:
        return Coordinates(name_match=0.9, bias=0.2, slope=8.0)

    @staticmethod
    def final() -> Coordinates:
        return Coordinates(name_match=0.2, type_hint=1.1, lsp=1.5, bias=0.4, slope=12.0)

    def problems(self) -> list[str]:
        """What lies outside the ranges: weights 0 to 2, bias 0 to 1, slope 0.1 to 50."""
        weights = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("bias", "slope")}
        out = [f"{k} must be in [0, 2]" for k, v in weights.items() if not 0 <= v <= 2]
        out += [] if 0 <= self.bias <= 1 else ["bias must be in [0, 1]"]
        return out + ([] if 0.1 <= self.slope <= 50 else ["slope must be in [0.1, 50]"])


STRATEGIES = {"same_file": (0.9, 3), "type_hint": (0.85, 2), "import": (0.8, 1), "name_match": (0.5, 0), "lsp": (0.95, 4)}


@dataclass(frozen=True)
class Policy:
    """Coordinates of the query policy."""

    weight_centrality: float = 1.0
    weight_uncertainty: float = 1.0
    weight_coherence: float = 1.0
    weight_causality: float = 0.5
    weight_bridge: float = 0.5
    temperature: float = 1.0
    gate: float = 0.1
    exploration_floor: float = 0.05
    utility_floor: float = 0.01
    latency_bias: float = 0.3
    mixing: float = 0.0
    normalisation: float = 0.0
    structural: float = 0.0
    semantic: float = 0.0
    spatial: float = 0.0


#: name: (least, most, logarithmic, default, neutral)
PARAMETERS: dict[str, tuple[float, float, bool, float, float]] = {
    "pagerank_alpha": (0.70, 0.95, False, 0.85, 0.85),
    "pagerank_chat_multiplier": (10.0, 200.0, True, 100.0, 1.0),
    "depth_weight_root": (0.5, 2.0, False, 1.0, 1.0),
    "depth_weight_moderate": (0.2, 1.0, False, 0.5, 1.0),
    "depth_weight_deep": (0.05, 0.5, False, 0.1, 1.0),
    "depth_weight_vendor": (0.001, 0.1, True, 0.01, 1.0),
    "boost_mentioned_ident": (2.0, 50.0, True, 10.0, 1.0),
    "boost_mentioned_file": (2.0, 20.0, True, 5.0, 1.0),
    "boost_chat_file": (5.0, 100.0, True, 20.0, 1.0),
    "boost_temporal_coupling": (1.0, 10.0, True, 3.0, 1.0),
    "boost_focus_expansion": (1.0, 20.0, True, 5.0, 1.0),
    "git_recency_decay_days": (7.0, 90.0, False, 30.0, 30.0),
    "git_recency_max_boost": (2.0, 20.0, True, 10.0, 1.0),
    "git_churn_threshold": (3.0, 15.0, False, 5.0, 10.0),
    "git_churn_max_boost": (2.0, 15.0, True, 6.0, 1.0),
    "focus_decay": (0.2, 0.8, False, 0.5, 0.5),
    "focus_max_hops": (1.0, 3.0, False, 2.0, 1.0),
}

#: intent: exponents of recency and churn, and the weight of reverse edges
RECIPES = {"Debug": (1.5, 0.8, 2.0), "Explore": (1.0, 1.0, 1.0), "Extend": (1.2, 0.5, 0.7), "Refactor": (0.8, 2.0, 1.0)}


def to_config(point: dict[str, float], base: RankingConfig = RankingConfig()) -> RankingConfig:
    """A parameter point as a configuration: whole numbers where the configuration has them."""
    own = {
        "alpha": "pagerank_alpha", "chat_multiplier": "pagerank_chat_multiplier", "depth_root": "depth_weight_root", "depth_moderate": "depth_weight_moderate",
        "depth_deep": "depth_weight_deep", "depth_vendor": "depth_weight_vendor", "boost_ident": "boost_mentioned_ident", "boost_file": "boost_mentioned_file",
        "boost_chat": "boost_chat_file", "boost_temporal": "boost_temporal_coupling", "boost_focus": "boost_focus_expansion", "recency_decay_days": "git_recency_decay_days",
        "recency_max": "git_recency_max_boost", "churn_max": "git_churn_max_boost", "focus_decay": "focus_decay",
    }
    out = {k: point[v] for k, v in own.items() if v in point}
    if "git_churn_threshold" in point:
        out["churn_threshold"] = round(point["git_churn_threshold"])
    if "focus_max_hops" in point:
        out["focus_hops"] = round(point["focus_max_hops"])
    return replace(base, **out)


@dataclass(frozen=True)
class ScanConfig:
    """What a directory scan takes. A custom exclude replaces the defaults; extend_exclude adds to them."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    extend_exclude: tuple[str, ...] = ()
    src: tuple[str, ...] = field(default=())
