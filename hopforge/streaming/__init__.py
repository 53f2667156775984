"""Nothing streams: all inputs are finite tables, read in splits by Spark.

The engine has no unbounded sources, watermarks or stateful operators; a
finite graph is processed batch by batch in ``plans.jobs``.
"""
