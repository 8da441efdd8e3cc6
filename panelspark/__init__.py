"""panelspark: entity x time panels on Spark.

Long observations from several sources are merged by source priority with
provenance, checked against row rules, imputed, encoded, split by entity,
scored with tree models, watched for drift and monitored on streams.  Every
operator is a DataFrame -> DataFrame function with column names as
parameters.
"""

__version__ = "0.1.0"
