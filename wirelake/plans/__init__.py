"""Compiled decode and encode plans: what of a message type becomes which column."""

from .compile import Plan, compile_plan, spark_type

__all__ = ["Plan", "compile_plan", "spark_type"]
