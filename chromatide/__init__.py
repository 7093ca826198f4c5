"""chromatide: single-cell chromatin-accessibility analytics as Spark jobs.

Every public operator is a function DataFrame -> DataFrame (or Column ->
Column for scalar functions).  Nothing in the core collects rows to the
driver; scalars such as a row count are the only values read back.
"""

__version__ = "0.1.0"
