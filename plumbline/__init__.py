"""Plumbline: evidence-grounded search over large document collections, as Spark jobs."""
