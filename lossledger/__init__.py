"""lossledger: revenue-loss analytics as PySpark DataFrame jobs."""

from lossledger.operators.attribution import attribute_deals, best_note_per_deal
from lossledger.operators.evaluate import (
    confusion_at,
    pr_curve,
    ranking_metrics,
)
from lossledger.operators.features import account_features
from lossledger.operators.ledger import loss_events, loss_ledger
from lossledger.operators.recommend import recommend
from lossledger.operators.rollups import loss_summary, loss_trend, segment_loss
from lossledger.operators.scoring import score_table
from lossledger.operators.taxonomy import RULES, Rule, classify
from lossledger.sources.tables import Tables, load_tables

__all__ = [
    "RULES",
    "Rule",
    "Tables",
    "account_features",
    "attribute_deals",
    "best_note_per_deal",
    "classify",
    "confusion_at",
    "load_tables",
    "loss_events",
    "loss_ledger",
    "loss_summary",
    "loss_trend",
    "pr_curve",
    "ranking_metrics",
    "recommend",
    "score_table",
    "segment_loss",
]
