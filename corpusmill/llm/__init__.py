"""Training-data operators: each module is one operator; queries.py registers the thin op queries."""
