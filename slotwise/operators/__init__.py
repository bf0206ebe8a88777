"""Operators over observation rows: diffs, history, state, frames, matching, scoring, extraction."""
