"""Runs built from the operators: experiment, bundle, scoring, reports, command line."""
