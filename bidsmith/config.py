"""Thresholds, weights and phrase sets. No secrets: connectors read theirs from the environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Fixed values of the rules; every operator takes them as parameters."""

    min_award: float = 1_000_000.0
    max_award: float = 10_000_000_000.0
    max_market_cap: float = 5_000_000_000.0
    filing_window_live_days: int = 7
    filing_window_days: int = 2
    dilution_window_days: int = 60
    press_window_days: int = 2
    press_lookback_days: int = 2
    least_confidence: str = "medium"
    score_threshold: int = 40
    take_profit: float = 0.08
    stop_loss: float = 0.07
    position_size: float = 200.0
    hold_days: int = 4


DEFAULT = Config()

# Weights of the five factors, sum 100.
WEIGHTS = {"value_to_mcap": 30, "sole_source": 25, "first_agency": 15, "hot_sector": 15, "no_pr": 15}
# Fixed values: (least share of market cap, points), first match counts; then 2.
RATIO_STEPS = ((0.10, 30), (0.05, 20), (0.02, 12), (0.01, 6))
RATIO_REST = 2
# Sector codes, the prefix of the wider sector, and its points.
HOT_SECTORS = ("336411", "336414", "336415", "336419", "334511", "334519", "541715", "518210", "336413", "927110")
WIDE_SECTOR, WIDE_POINTS = "33641", 7
# Confidence labels, lowest first.
CONFIDENCE = ("none", "low", "medium", "medium_high", "high")
# Forms of dilutive filings.
DILUTIVE_FORMS = ("S-1", "S-3", "S-1/A", "S-3/A")
# Names of press wires, in lower case.
PRESS_WIRES = ("prnewswire", "businesswire", "globenewswire", "accesswire")
# Phrases of notices and of bulk records.
SOLE_NOTICE = ("sole source", "sole-source", "only one responsible source", "justification for other than full and open")
IDIQ_NOTICE = ("idiq", "indefinite delivery", "indefinite quantity", "id/iq", "indefinite-delivery", "indefinite-quantity")
SOLE_BULK = ("sole source", "sole-source", "only one source", "other than full", "8(a) sole")
IDIQ_BULK = ("idiq", "indefinite delivery", "indefinite quantity")
# Address marks in names.
ADDRESS_MARKS = (" PO BOX ", " SUITE ", " STE ", " STE.", " BLDG ", " FLOOR ", " FL ")
# Marks of log lines.
ERROR_MARKS = ("ERROR", "WARNING", "FAILED", "EXCEPTION", "TRACEBACK")
SUMMARY_MARKS = ("===", "---", "│", "├", "└", "Summary", "Results", "Total")
# Text classes of lines.
ERROR_WORDS = r"\b(error|exception|fail(?:ed|ure)?|fatal|critical|crash|panic)\b"
IMPORTANT_WORDS = r"\b(important|note|todo|fixme|hack|xxx|bug|fix)\b"
SECURITY_WORDS = r"\b(security|auth|password|secret|token)\b"
ERROR_INDICATORS = ("error", "fail", "exception", "traceback", "fatal", "panic", "crash")
# Marks of code.
CODE_MARKS = r"(?m)(?:def |class |function |const |let |var |import |from |if \(|for \(|while \(|switch \(|try \{|catch \(|=>|->|\{\{|\}\}|;$)"
# Marks of HTML.
HTML_MARKS = ("<head", "<body", "<div", "<script", "<style", "<meta", "<link", "<!doctype")


@dataclass(frozen=True)
class Grid:
    """Parameter values of a grid search. The defaults are fixed values: 9,720 combinations."""

    take_profit: tuple[float, ...] = (0.05, 0.08, 0.10, 0.12, 0.15, 0.20)
    stop_loss: tuple[float, ...] = (0.02, 0.03, 0.04, 0.05, 0.06)
    hold: tuple[int, ...] = (1, 2, 3, 4, 5, 7)
    threshold: tuple[int, ...] = (5, 10, 15, 20, 25, 30, 35, 40, 50)
    max_market_cap: tuple[float, ...] = (100e6, 150e6, 200e6, 300e6, 500e6, 1e9)
