"""All named queries of the audit engine."""

from __future__ import annotations

from auditlake.plans import acceptance, contracts, diagnosis, evidence, formulas, layout, maps, office, packages, pairs, registry, repairs, texts, versions  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
