"""DataFrame operators: experiment results, statistics, behaviour and cohort jobs, ETL."""
