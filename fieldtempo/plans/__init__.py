"""Whole analyses built from the operators."""

from fieldtempo.plans.incremental import update_report
from fieldtempo.plans.report import report_tables, write_report

__all__ = ["report_tables", "update_report", "write_report"]
