"""Job parameters. Every job takes one frozen config; there are no module-level knobs elsewhere."""

from __future__ import annotations

from dataclasses import dataclass, field

# The five channels every source is mapped to.
CHANNELS = ("email", "organic", "paid_social", "referral", "search")


@dataclass(frozen=True)
class CleaningConfig:
    iqr_multiplier: float = 3.0
    outlier_column: str = "net_amount"


@dataclass(frozen=True)
class ShareScenario:
    """Budget split by share of the total: each channel gets between min_pct and max_pct of it."""

    scenario_id: str = "base"
    budget_total: float = 10_000_000.0
    min_pct: float = 0.05
    max_pct: float = 0.45


@dataclass(frozen=True)
class ChannelBounds:
    """Absolute spend limits of one channel."""

    channel: str
    min_spend: float
    max_spend: float


# The default absolute limits per channel for a monthly budget.
DEFAULT_BOUNDS = (
    ChannelBounds("email", 500_000.0, 5_000_000.0),
    ChannelBounds("organic", 100_000.0, 1_500_000.0),
    ChannelBounds("paid_social", 5_000_000.0, 20_000_000.0),
    ChannelBounds("referral", 1_000_000.0, 5_000_000.0),
    ChannelBounds("search", 10_000_000.0, 25_000_000.0),
)


@dataclass(frozen=True)
class BoundsScenario:
    """Budget split by marginal revenue inside absolute limits; limits and weights can be stressed per scenario."""

    scenario_id: str = "base"
    budget_total: float = 40_000_000.0
    bounds: tuple[ChannelBounds, ...] = DEFAULT_BOUNDS
    weight_factor: tuple[tuple[str, float], ...] = ()


@dataclass(frozen=True)
class BudgetConfig:
    lookback_days: int = 90
    margin_window: str = "lookback"  # or "all"
    best_multiplier: float = 1.2
    worst_multiplier: float = 0.8
    share_scenarios: tuple[ShareScenario, ...] = (ShareScenario(),)
    bounds_scenarios: tuple[BoundsScenario, ...] = (BoundsScenario(),)
    roas_changes_pct: tuple[int, ...] = (-10, 0, 10)
    budget_changes_pct: tuple[int, ...] = (-10, 0, 10)
    horizon_days: int | None = 30  # None: as many days as the history has
    variation: float = 0.10


@dataclass(frozen=True)
class RegressionConfig:
    split_buckets: int = 5
    test_bucket: int = 0


@dataclass(frozen=True)
class TouchConfig:
    """Which sessions share the credit of an order, and how much older ones count."""

    lookback_days: int = 30
    half_life_days: float = 7.0

    @property
    def day_weights(self) -> tuple[int, ...]:
        """Weight of a session so many days before the order's day: whole numbers, one at least."""
        return tuple(max(1, round(2 ** (20 - d / self.half_life_days))) for d in range(self.lookback_days + 1))


@dataclass(frozen=True)
class LayoutConfig:
    """How work is cut into tasks; no value changes a result."""

    orders_per_piece: int = 10_000  # of one session, before its orders are joined in pieces
    array_channels: int = 64  # of a budget scenario that are shared out as one array; more are shared in rounds
    missing_key_spread: int = 4_096  # parts that rows without a lookup key scatter over


@dataclass(frozen=True)
class JobConfig:
    base_path: str
    output_path: str
    file_format: str = "parquet"
    write_dq_report: bool = True
    revenue_column: str = "gross_amount"
    cleaning: CleaningConfig = field(default_factory=CleaningConfig)
    budget: BudgetConfig = field(default_factory=BudgetConfig)
    regression: RegressionConfig = field(default_factory=RegressionConfig)
    touches: TouchConfig = field(default_factory=TouchConfig)
    layout: LayoutConfig = field(default_factory=LayoutConfig)
