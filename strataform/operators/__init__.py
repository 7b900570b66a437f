"""Rollup, snapshot, insight and report operators."""
