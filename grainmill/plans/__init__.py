"""Multi-step Spark jobs that several operators build on."""
