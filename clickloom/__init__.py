"""Clickstream analytics and product recommendations as Spark DataFrame operators."""
