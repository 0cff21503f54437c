"""meridia: geospatial feature data on Spark, and operators for training corpora."""
