"""tickerloom: market time-series analytics written as Spark DataFrame jobs.

Every public operator takes and returns DataFrames, so it composes with ``DataFrame.transform`` and stays lazy
until the caller writes or collects something.
"""
