"""All registered queries of the library and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of loomwork.plans, each with QUERIES (name -> callable) and ORACLES (name -> SQL).
PLAN_MODULES: list[str] = ["batch", "streams", "jobs", "ad_click", "learning"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for module in PLAN_MODULES:
        part = getattr(import_module(f"loomwork.plans.{module}"), attribute)
        if clash := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
