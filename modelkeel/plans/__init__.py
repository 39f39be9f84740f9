"""Composite jobs: training, the pipeline with its gates, the drift monitor."""
