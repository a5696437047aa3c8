"""Rankloom: panel scoring, ranking, splitting and evaluation as Spark DataFrame plans."""
