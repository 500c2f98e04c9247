"""postmine: turn tables or streams of pages and posts into ranked product ideas on Spark.

Request building, reply parsing, de-duplication, batching, aggregation and ranking are
DataFrame / SQL expressions. Python runs only for HTML block extraction, model calls and
custom streaming state.
"""

__version__ = "0.1.0"
