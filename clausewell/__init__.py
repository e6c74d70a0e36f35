"""Clausewell: document retrieval, clause analytics and corpus preparation as Spark DataFrame operators."""
