"""DataFrame operators: split, layout, sizing, metrics, recommender, run logs."""
