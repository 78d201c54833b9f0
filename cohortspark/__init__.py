"""Spark jobs over a reviewed applicant corpus and the conversations that cite it."""
