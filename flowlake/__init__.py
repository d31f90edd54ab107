"""Network-flow telemetry on Spark: every operator is a ``DataFrame -> DataFrame`` function."""
