"""Operators over learning graphs, question banks, attempt logs and transcripts, as lazy DataFrame functions."""
