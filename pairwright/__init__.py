"""Paired counterfactual analytics of automated judges, on Spark."""
