"""Column expressions. None of them triggers a job, a shuffle or Python workers."""
