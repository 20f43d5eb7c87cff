"""A PySpark-native engine for time-to-event data with time-varying covariates."""
