"""Detector training and scoring on Spark ML."""
