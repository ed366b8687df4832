"""Small tests of the operators for training data."""
