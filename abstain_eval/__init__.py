"""Spark jobs that prepare tabular clinical cases, render requests, read answers and score them."""
