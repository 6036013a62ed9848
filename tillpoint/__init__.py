"""tillpoint: retail sales analytics as Spark DataFrame jobs.

Sub-packages:

* ``sources``   – table loading, CSV ingest, catalog listings, sinks, ingest ledger
* ``functions`` – Column-expression helpers (text, numbers, dates, JSON)
* ``operators`` – DataFrame -> DataFrame operators (cleaning, validation,
  profiling, KPIs, schema comparison, query runner, log normalisation)
* ``plans``     – composed jobs (sales_wide star join, preprocessing job,
  KPI bundle, question catalogue) and the registry used by ``__spark_entry__``
* ``streaming`` – incremental (availableNow) variant of the row-local cleaning
"""

__version__ = "0.1.0"
