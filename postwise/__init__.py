"""Post analytics on Spark: text, features, models, reports, metrics, streams."""
