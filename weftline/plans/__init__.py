"""From a job's document to a DataFrame."""
