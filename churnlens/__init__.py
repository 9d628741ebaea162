"""churnlens: customer-behaviour analytics (RFM, cohorts, churn, tests) on Spark DataFrames."""

__version__ = "0.1.0"
