"""Operators: functions from tables of samples to tables of samples."""
