"""quernel: vector search, self-tuning, concept graphs and text preparation as Spark DataFrames."""
