"""spendaudit — compute-usage cost audits as Spark DataFrame operators.

Modules:

* ``spendaudit.functions.costing`` — ``with_list_cost`` (time-bounded price
  validity join), ``with_catalog_cost``.
* ``spendaudit.operators.audits`` — top cost centres, SKU breakdown, idle
  clusters, compute efficiency, spend spikes, pipeline waste.
* ``spendaudit.operators.monitors`` — as-of driven monitors.
* ``spendaudit.operators.savings`` / ``reports`` / ``compliance`` — savings
  estimates, report datasets, policy / budget / quality checks.
* ``spendaudit.streaming.hourly`` — Structured Streaming forms.
* ``spendaudit.sources`` — readers and writers; ``spendaudit.plans`` — the
  registered queries, their DuckDB oracle and session settings.
"""

from .schema import (COSTED_USAGE_SCHEMA, META_SCHEMA, PRICES_SCHEMA,  # noqa: F401
                     USAGE_SCHEMA)

__version__ = "0.1.0"
