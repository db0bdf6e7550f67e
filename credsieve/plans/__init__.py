"""The scans, assembled from functions and operators."""
