"""Spark jobs for irregularly sampled time series organised into stays."""
