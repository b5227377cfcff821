"""End-to-end plans: training, index building, prediction."""
