"""Training-data operators. Each module holds one operator; queries.py holds their thin queries."""
