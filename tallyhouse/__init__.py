"""Retail sales warehouse on Spark: clean order lines, model a star schema, analyse it."""

from tallyhouse.plans.warehouse import Warehouse

__all__ = ["Warehouse"]
