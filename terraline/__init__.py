"""terraline: location, payoff, key-value and design analytics as Spark DataFrame operators."""
