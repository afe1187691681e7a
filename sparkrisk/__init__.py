"""sparkrisk - DataFrame-in / DataFrame-out operators for preparing, sampling,
modelling and evaluating tabular data on Spark.

Subpackages
-----------
sources    CSV / Parquet readers and writers, model persistence
functions  column expressions: seeded hashes, two-level rank, scalar recodes
operators  profiles, joins, sampling, imputation, features, models, metrics
plans      end-to-end flows over whole tables and the query registry
streaming  scoring a streaming DataFrame with a fitted model
"""

__version__ = "0.1.0"
