"""Scalar functions: Column in, Column out. Nothing here runs Python on the executors except what
says so."""
