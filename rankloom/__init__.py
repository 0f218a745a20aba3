"""rankloom: ranking-feature operators for Spark.

Turns search-request, candidate, click/booking and booking-status logs into
ranking features and ranked results, as plain DataFrame -> DataFrame
functions over Spark SQL, Spark ML and Structured Streaming.
"""

__version__ = "0.1.0"
