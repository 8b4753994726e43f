"""souk — marketplace analytics as Spark DataFrame operators.

Layout:
    sources/    table access: driver tables, reference-schema fixtures, CSV ingest, calendar
    functions/  column-expression helpers (T-SQL date rules, rounding, label ladders)
    operators/  analysis operators, one module per business domain, plus the
                distributed ranking operators in ``operators.ranks``
    plans/      the query catalogue (name -> DataFrame builder) and its SQL oracles
    llm/        training-data pipeline operators (optional; nothing here imports it)

Every operator takes DataFrames in the reference schema and returns a lazy
DataFrame; nothing is collected to the driver except single rows of bounds.
"""

from souk.session import get_spark

__all__ = ["get_spark"]
