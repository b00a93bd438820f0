"""Operators over signals, tracks, results and tasks."""
