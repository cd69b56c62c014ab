"""Operators over token tapes, spans, relations and graphs, as DataFrame functions."""
