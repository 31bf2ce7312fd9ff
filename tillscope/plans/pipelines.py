"""Whole analyses, from order lines to the final table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.operators import baskets, lifetime, margins, rfm, rules
from tillscope.operators.fitting import fit_bgnbd, fit_pnbd, fit_spend, parameters
from tillscope.session import materialise


def segment_customers(lines: DataFrame, analysis_date: str) -> DataFrame:
    """RFM measures, scores and segment per customer."""
    return rfm.assign_segments(rfm.rfm_table(lines, analysis_date))


def lifetime_values(
    lines: DataFrame,
    cutoff: str,
    bgnbd_params: Mapping[str, float],
    pnbd_params: Mapping[str, float],
    spend_params: Mapping[str, float],
    max_transactions: int = lifetime.MAX_TRANSACTIONS,
    horizon_weeks: float = lifetime.HORIZON_WEEKS,
) -> DataFrame:
    """Order lines to predicted and real value per customer, with given parameters.

    One scan and two shuffles: lines to customer-days, customer-days to customers.
    """
    log = lifetime.event_log(lines, cutoff, max_transactions)
    history = lifetime.purchase_history(log, cutoff)
    return lifetime.score(history, bgnbd_params, pnbd_params, spend_params, horizon_weeks)


def fitted_lifetime_values(
    lines: DataFrame,
    cutoff: str,
    max_transactions: int = lifetime.MAX_TRANSACTIONS,
    horizon_weeks: float = lifetime.HORIZON_WEEKS,
    allow_unfinished: bool = False,
) -> DataFrame:
    """The same with parameters fitted to the calibration period.

    ``fits_converged`` and ``fits_at_edge`` tell whether all three fits converged
    and whether one ended where the data do not identify a parameter. A fit that
    has not converged raises unless ``allow_unfinished``.
    """
    log = lifetime.event_log(lines, cutoff, max_transactions)
    history = materialise(lifetime.purchase_history(log, cutoff))
    fits = [fit_bgnbd(history), fit_pnbd(history), fit_spend(history)]
    states = [fitted.select("converged", "at_edge").first() for fitted in fits]
    scored = lifetime.score(
        history, *[parameters(fitted, allow_unfinished) for fitted in fits], horizon_weeks
    )
    return scored.withColumns(
        {
            "fits_converged": F.lit(all(s["converged"] for s in states)),
            "fits_at_edge": F.lit(any(s["at_edge"] for s in states)),
        }
    )


def priced_rules(
    lines: DataFrame,
    item_margins: DataFrame,
    item: str = baskets.ITEM,
    min_support: float = rules.MIN_SUPPORT,
    min_confidence: float = rules.MIN_CONFIDENCE,
    max_length: int = rules.MAX_LENGTH,
) -> DataFrame:
    """Mine, prune and price rules: the rule report."""
    itemsets = rules.mine_baskets(baskets.collect_baskets(lines, item), min_support, max_length)
    # Rules are read several times by the pruning and by the report.
    found = materialise(rules.association_rules(itemsets, min_confidence))
    return margins.rule_report(materialise(rules.prune_subsumed(found)), item_margins)
