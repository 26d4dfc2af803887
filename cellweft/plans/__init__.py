"""Assembled plans: the analyzer facade, template sheets over tables, and the registered queries."""
