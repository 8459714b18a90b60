"""Spark jobs for population genetics and omics tables at cohort scale."""
