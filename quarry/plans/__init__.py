"""Query plans over the test corpus: the registered queries and their SQL oracles."""
