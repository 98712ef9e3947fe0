"""Graph, join and report operators above the DataFrame API."""
