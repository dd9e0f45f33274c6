"""Veilscan: a Spark-native scanner for hidden marks, secrets and risky code in texts."""

from veilscan.functions.stego import MarkStyle
from veilscan.plans.reports import corpus_report, file_report, severity_histogram
from veilscan.plans.scan import explode_findings, ordered_findings, scan

__all__ = [
    "MarkStyle",
    "corpus_report",
    "explode_findings",
    "file_report",
    "ordered_findings",
    "scan",
    "severity_histogram",
]
