"""Gesture-landmark corpora and learner analytics as Spark DataFrame functions."""
