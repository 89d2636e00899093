"""All registered queries and their check SQL."""

from . import checks_functions, checks_linkage, checks_reports, checks_roster  # noqa: F401
from .register import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
