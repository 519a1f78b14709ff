"""Multi-step batch jobs."""
