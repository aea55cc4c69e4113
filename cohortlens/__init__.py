"""Evaluation, cohort and audit operators for scored-element studies, written for Spark DataFrames."""
