"""Registered queries over the provided tables, with equivalent SQL."""
