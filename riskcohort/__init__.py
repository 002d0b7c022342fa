"""riskcohort: risk-cohort construction, rule evaluation and model evaluation on Spark."""
