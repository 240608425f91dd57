"""colligo: profiling, matching, transforming and reporting on tabular exports, as Spark plans."""
