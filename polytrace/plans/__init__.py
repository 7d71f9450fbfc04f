"""Pipelines: chains of operators, and the script language that writes them down."""
