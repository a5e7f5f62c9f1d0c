"""Funnel definition: ordered stages, their flag columns and hit action codes.

The funnel is *open and unordered*: a session reaches a stage when it has any
hit with that stage's action code, regardless of hit order or earlier stages.
The purchase stage is an exception: ``purchased`` comes from the session's
transaction count, not from a purchase hit.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Stage:
    label: str          # display name in funnel tables
    flag: str           # boolean column on the clean sessions table
    code: int           # eCommerceAction action_type of the hit
    event: str          # event_type name in the long event log
    from_hits: bool = True   # False: flag derived from session totals


@dataclass(frozen=True)
class FunnelSpec:
    stages: tuple[Stage, ...]
    entry_label: str = "Sessions"
    # Short names used by the per-device count table.
    count_names: tuple[str, ...] = field(default=())
    # Short stage names used in step-rate column names (a_to_b).
    step_names: tuple[str, ...] = field(default=())

    @property
    def flags(self) -> list[str]:
        return [s.flag for s in self.stages]

    @property
    def labels(self) -> list[str]:
        return [self.entry_label] + [s.label for s in self.stages]

    @property
    def hit_stages(self) -> list[Stage]:
        return [s for s in self.stages if s.from_hits]

    @property
    def codes(self) -> list[int]:
        return [s.code for s in self.stages]

    @property
    def purchase(self) -> Stage:
        return self.stages[-1]


# --- Fixed values (stage codes, labels and names the results depend on) ------
# Action codes: 2 product_view, 3 add_to_cart, 5 checkout, 6 purchase.
# Stage labels in order: Sessions, Product View, Add to Cart, Checkout, Purchase.
# Flag columns: reached_product_view, reached_cart, reached_checkout, purchased.
# Per-device count columns: product_view, cart, checkout, purchase.
# Step-rate names: view_to_cart, cart_to_checkout, checkout_to_purchase.
DEFAULT_SPEC = FunnelSpec(
    stages=(
        Stage("Product View", "reached_product_view", 2, "product_view"),
        Stage("Add to Cart", "reached_cart", 3, "add_to_cart"),
        Stage("Checkout", "reached_checkout", 5, "checkout"),
        Stage("Purchase", "purchased", 6, "purchase", from_hits=False),
    ),
    entry_label="Sessions",
    count_names=("product_view", "cart", "checkout", "purchase"),
    step_names=("view", "cart", "checkout", "purchase"),
)

# Micros per currency unit (revenue is stored as integer micros).
MICROS = 1_000_000
