"""The link run: slips and receipts to links, audit, misses and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import MATCH, MatchConfig
from ..operators import linkage, misses
from ..operators.scale import store


@dataclass
class LinkRun:
    employees: DataFrame
    pages: DataFrame
    links: DataFrame      # every chosen link; losers of page conflicts have accepted = false
    prepared: linkage.Prepared
    cfg: MatchConfig

    def misses(self) -> DataFrame:
        return misses.explain_misses(self.prepared, self.links, self.cfg)


def run_links(slips: DataFrame, receipts: DataFrame, cfg: MatchConfig = MATCH, phase=None) -> LinkRun:
    """``slips`` and ``receipts`` are page tables. Extracted names and prepared pages are stored once."""
    employees = store(linkage.employees_from_slips(slips, phase), "employees")
    pages = store(linkage.prepare_pages(receipts), "prepared-pages")
    prepared = linkage.prepare_run(employees, pages, cfg)
    links = store(linkage.link_prepared(prepared, cfg), "links")
    return LinkRun(employees, pages, links, prepared, cfg)
