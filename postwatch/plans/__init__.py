"""Jobs made of several operators: table derivation, the roll-up store, text classification."""
