"""millrace: paired-record analytics and corpus preparation as plain Spark jobs."""
