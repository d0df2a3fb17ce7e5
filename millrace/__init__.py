"""millrace: software-delivery analytics and corpus preparation as Spark jobs."""
