"""Security-shaped views over the test tables: ``views`` for Spark, ``duck`` for the check SQL."""
