"""Player lifecycle analytics on Spark: features, churn scores, segments and reports."""
