"""Registered queries: one Spark plan per operator and its SQL counterpart."""
