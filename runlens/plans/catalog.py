"""All registered queries. Importing a catalog module registers its queries."""

from runlens.plans import (  # noqa: F401
    catalog_config,
    catalog_curves,
    catalog_files,
    catalog_jobs,
    catalog_logs,
    catalog_reduce,
    catalog_stats,
    catalog_streams,
)
from runlens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
