"""Bindings of the operators to tables, with equivalent SQL."""
