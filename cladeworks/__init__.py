"""Cohort-scale genotype-phenotype analytics as PySpark DataFrame plans."""
