"""Registered queries over the driver's tables, with their oracles."""

from contract import change_cases, history_cases, job_cases, plan_cases, source_cases, text_cases  # noqa: F401
from contract.case import CASES

__all__ = ["CASES"]
