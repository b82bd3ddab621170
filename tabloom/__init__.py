"""Tabular analytics on Spark DataFrames."""
from .operators.ordered import asc, desc
from .operators.reconcile import Plan, reconcile
from .session import Workbench
from .staging import session, stage

__all__ = ["Plan", "Workbench", "asc", "desc", "reconcile", "session", "stage"]
