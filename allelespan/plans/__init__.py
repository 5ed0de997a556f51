"""Query functions over a cohort: tables and parameters in, a DataFrame out."""
